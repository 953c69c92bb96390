import re

import pytest

from unitgraph.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, rest = share * sum(sizes.values()), {}, set(names)
    while rest:
        total = sum(w[s] for s in rest)
        over = {s for s in rest if left * w[s] / total > most * sizes[s]}
        if not over:
            out.update({s: left * w[s] / total for s in rest})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        rest -= over
    return out


@pytest.mark.parametrize("bucket", [4, 128])
def test_mix(spark, bucket):
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 50)), ["a", "b", "c", "d", None][min(4, i % 9)], i) for i in range(900)]
    rows += [(5, None, "a", 0), (None, "x y z", "b", 0), (7, "same row", "c", 1), (7, "same row", "c", 1), (8, " \t\x0b", "zero", 1), (9, "w\x1cw é\x85é \n", "é", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    out = mixing.mix_report(df, bucket=bucket)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    got = out.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _, _ in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    seen = {}
    for r in got:
        seen.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    assert set(seen) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (total, target), docs in seen.items():
        alike = sum((sizes[s], round(want[s], 6)) == (total, target) for s in sizes)
        assert abs(sum(r.taken for r in docs) - alike * target) <= alike * max(r.size for r in docs)
        assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in docs)
        if total:
            assert all(r.copies in (int(target / total), int(target / total) + 1) for r in docs if r.size)
    again = mixing.mix_report(df.repartition(7), bucket=bucket).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(df, bucket=bucket)
    assert mixed.columns == df.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in got)


def test_copy_rates_are_unbiased(spark):
    rows = [(i, "w " * (1 + i % 7), "a") for i in range(300)] + [(1000 + i, "w " * 9, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    means = {}
    for seed in range(3):
        for r in mixing.mix_report(df, seed=seed, bucket=16).collect():
            means.setdefault((r.source_size, r.target), []).append(r.copies)
    for (total, target), copies in means.items():
        assert abs(sum(copies) / len(copies) - target / total) < 0.12


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix_report(df).count() == 0
    assert mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], df.schema)
    assert [(r.size, r.taken, r.target) for r in mixing.mix_report(blank).collect()] == [(0, 0, 0.0)] * 2


def test_clashing_names(spark):
    names = ["_row", "_copies", "_rows", "_again", "own_0", "own_1", "id", "row", "size", "copies", "sid", "a.b"]
    df = spark.createDataFrame([(i, "some words here", "ab"[i % 2], *range(len(names))) for i in range(6)] + [(9, "twice", "a", *range(len(names)))] * 2, ["doc_id", "text", "source", *names])
    out = mixing.mix(df)
    assert out.columns == df.columns
    rows = [tuple(r) for r in out.collect()]
    assert rows and {r[3:] for r in rows} == {tuple(range(len(names)))}
    assert mixing.mix_report(df).count() == 8
