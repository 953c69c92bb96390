import zlib

import numpy as np
import pytest

from unitgraph.llm import quality


def plain_features(text):
    out = set()
    for i in range(len(text)):
        h = 0
        for n in range(min(4, len(text) - i)):
            h = ((h ^ (text[i + n] + 1)) * int(quality._MULTIPLIERS[n])) & 0xFFFFFFFF
            h ^= h >> 15
            out.add(((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> 14)
    words = text.split()
    runs = [k for i in range(len(words)) for k in range(1, 9) if len(set(words[i : i + k + 1])) == 1 and i + k < len(words)]
    return sorted(out) + list(range(quality.BUCKETS, quality.BUCKETS + max(runs, default=0)))


def test_features(monkeypatch):
    seen = np.zeros(quality.SIZE, np.uint8)
    text = "Ein Text, überall!\n%%% a a a b b ".encode() * 3
    assert quality.features(text, seen).tolist() == plain_features(text)
    assert not seen.any() and not len(quality.features(b"", seen))
    for block in (1, 5, 7):
        monkeypatch.setattr(quality, "BLOCK", block)
        for case in (text, b"".join(text.split()), b"ab ab ab  ab abc abc " * 4):
            assert quality.features(case, seen).tolist() == plain_features(case)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    y = np.where(np.array([r[0] for r in rows]) < 4, 1.0, -1.0)
    ratio, cost = np.ones(quality.SIZE), np.ones(60)
    w, b = quality._descent(rows, y, ratio, 0.0, cost, 3000, 1)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)
    x[:, 30] = 1

    def primal(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    v = np.r_[w[:30], b]
    best = primal(v)
    for _ in range(300):
        assert primal(v + rng.normal(0, 0.02, 31)) >= best - 1e-3


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(data):
    docs, labels = data
    got = quality.predictions(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.quality for r in held) / len(held)
    assert right >= 0.9, right
    assert got.count() == docs.count()
    assert sorted(quality.keep_good(docs, labels).columns) == sorted(docs.columns)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 1.0), (None, "good text", 2.0), (3, "x" * 200000, 1.0), (3, "x" * 200000, 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1), (3, 5)], "doc_id bigint, quality int")
    for lab in (labels, labels.limit(0)):
        got = quality.predictions(docs, lab).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.predictions(docs.limit(0), labels).count() == 0
    assert quality.score(docs, quality.fit([], np.zeros(0))).columns == ["doc_id", "text", "score"]


def test_scores_against_brute_force(spark):
    """Training and scoring written again with dense arrays and dictionaries; the descent's optimum found by plain passes."""
    good, bad = ["the quick brown fox", "a sound sentence about foxes", "plain words and more", "brown words again"], ["%%% $$$ buy now", "$$$ spam spam spam", "%%% click ###", "buy buy buy $$$"]
    docs = [(i, f"{t} {i % 7}", i < 80) for i, t in enumerate((good * 20 + bad * 20))]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in docs], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.predictions(df, labels, epochs=3000).collect()}

    used = [(i, t, 1.0 if g else -1.0) for i, t, g in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    rng, y = np.random.default_rng(7), np.array([s for *_, s in used])
    held = set()
    for side in (1.0, -1.0):
        own = rng.permutation(np.flatnonzero(y == side))
        held |= set(own[: len(own) // 4].tolist())
    fitted = [k for k in range(len(used)) if k not in held]
    found = [plain_features(t.encode()) for _, t, _ in used]
    count = {s: {} for s in (1.0, -1.0)}
    for k in fitted:
        for f in found[k]:
            count[y[k]][f] = count[y[k]].get(f, 0) + 1
    total = {s: quality.SIZE + sum(c.values()) for s, c in count.items()}
    ratio = {f: np.log((count[1.0].get(f, 0) + 1) / total[1.0]) - np.log((count[-1.0].get(f, 0) + 1) / total[-1.0]) for f in {*count[1.0], *count[-1.0]}}
    floor = float(np.median([sum(ratio.get(f, 0) ** 2 for f in found[k]) for k in fitted]))
    names = sorted(ratio)
    place = {f: n for n, f in enumerate(names)}

    def vector(features):
        v = np.zeros(len(names) + 1)
        for f in features:
            if f in place:
                v[place[f]] = ratio[f]
        v /= np.sqrt((v**2).sum() + floor)
        v[-1] = 1
        return v

    x = np.array([vector(found[k]) for k in fitted])
    alpha, w = np.zeros(len(fitted)), np.zeros(len(names) + 1)
    for _ in range(3000):
        for k, row in enumerate(x):
            new = min(max(alpha[k] - (y[fitted[k]] * (w @ row) - 1) / (row @ row), 0), 1)
            w += (new - alpha[k]) * y[fitted[k]] * row
            alpha[k] = new
    on = sorted(held)
    slope, offset = quality._logistic(np.array([vector(found[k]) @ w for k in on]), y[on])
    want = {i: 1 / (1 + np.exp(-(slope * (vector(plain_features(t.encode())) @ w) + offset))) for i, t, _ in docs}
    assert max(abs(got[i] - want[i]) for i in got) < 0.01
    assert all((got[i] >= 0.5) == g for i, _, g in docs)


def test_clashing_names(spark):
    names = ["_score", "_bytes", "own_0", "own_1", "score", "id", "a.b"]
    docs = spark.createDataFrame([(i, "good plain words" if i % 2 else "%%% $$$", *range(len(names))) for i in range(40)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, labels, threshold=0.5)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert {r[0] for r in rows} == set(range(1, 40, 2)) and {r[2:] for r in rows} == {tuple(range(len(names)))}
