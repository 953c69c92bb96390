import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from unitgraph.llm import simhash


def plain_fingerprint(text, words):
    import re

    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_diff):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= max_diff:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@given(st.text(alphabet="aB é\t\n\x0b\x1c z", max_size=60), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text, words):
    assert simhash.fingerprint(text.encode(), words) == plain_fingerprint(text, words)


@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(0, 6))
@settings(max_examples=60, deadline=None)
def test_forest_connects_what_pairs_connect(seed, n, d):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = centres[rng.integers(0, 4, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fps = np.unique(fps)
    a, b = simhash.spanning_links(np.zeros(len(fps), np.int64), fps, d)
    assert all((int(x) ^ int(y)).bit_count() <= d for x, y in zip(a, b))
    assert len(a) <= max(0, len(fps) - 1)
    place = {int(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        p, q = find(place[int(x)]), find(place[int(y)])
        root[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(fps))] == plain_components(fps, d)


@pytest.mark.parametrize("chunk", [3, 512])
@pytest.mark.parametrize("shared", [1, 2, None])
def test_links_are_whole(spark, chunk, shared):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = fps[rng.integers(0, 6, 120)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near, np.zeros(1, np.uint64)]))
    from unitgraph.llm.shared import components

    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    got = {r.node: r.root for r in components(simhash.links(df, 4, chunk, shared)).collect()}
    want = plain_components(fps, 4)
    signed = fps.view(np.int64)
    classes = {}
    for i, w in enumerate(want):
        classes.setdefault(w, set()).add(int(signed[i]))
    for members in classes.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}
        else:
            assert not members & set(got)


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "x"), (3, text, "y"), (None, text, "z"), (9, None, "n"), (8, "", "e"), (8, "", "e"), (7, " \t\n", "w"), (1, "Other words HERE", "o"), (2, "other words here", "o"), (11, "x" * 200000, "long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in out.collect())
    f = {t: f"{plain_fingerprint(t, 4):016x}" for t in (text, "", "other words here", "x" * 200000)}
    assert got == sorted([(5, f[text], 3), (3, f[text], 3), (-1, f[text], 3), (9, f[""], 7), (8, f[""], 7), (8, f[""], 7), (7, f[""], 7), (1, f["other words here"], 1), (2, f["other words here"], 1), (11, f["x" * 200000], 11)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 7, 11]


def test_keep_one_by_row(spark):
    """Two texts of one id: the near copy of another document goes, the other text stays."""
    copy, own = " ".join(f"word{i}" for i in range(100)), " ".join(f"other{i}" for i in range(100))
    df = spark.createDataFrame([(1, copy), (2, copy), (2, own), (2, own), (None, copy)], "doc_id bigint, text string")
    kept = sorted(((r.doc_id or -1, r.text) for r in simhash.keep_one(df).collect()))
    assert kept == [(-1, copy), (1, copy), (2, own)]


def test_keep_one_with_clashing_names(spark):
    names = ["__key", "__gone", "__row", "__id", "_row", "own_0", "own_1", "id", "fp", "component_id", "fingerprint", "a.b"]
    df = spark.createDataFrame([(i, "the same words in every row", *range(len(names))) for i in range(3)], ["doc_id", "text", *names])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(0, "the same words in every row", *range(len(names)))]


def test_links_in_portions(spark, monkeypatch):
    """Few rows held at a time: the same components."""
    from unitgraph.llm.shared import components

    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, *[fps ^ (np.uint64(1) << np.uint64(k)) for k in (3, 17, 40)]])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    whole = sorted(map(tuple, components(simhash.links(df)).collect()))
    monkeypatch.setattr(simhash, "HELD", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, components(simhash.links(df)).collect())) == whole and len(whole) == len(fps)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
