import numpy as np
import pytest

from unitgraph.llm import ann


def brute(rows, every=20, top=20):
    seen = {(i, tuple(v)) for i, v in rows}
    ids = np.array(sorted(seen, key=str), dtype=object)
    out = {}
    for i, v in seen:
        if i % every == 0:
            scored = sorted((-float((np.array(w) * np.array(v)).sum()), j) for j, w in ids if j != i)
            out[i] = [(j, -s) for s, j in scored[:top]]
    return out


def collect(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("share, recall", [(1.0, 1.0), (0.55, 0.9)])
def test_recall(spark, share, recall):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collect(ann.search(df, share=share, least=1, block_rows=500, query_rows=40))
    want = brute(rows)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= recall * 20 * len(want)
    for i in want:
        assert len(got[i]) == 20
        for j, s in got[i]:
            assert abs(s - float((x[i] * x[j]).sum())) < 1e-12
        if share == 1.0:
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_hot_vector_and_ties(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(1000 + i, [float(i % 7), 1.0, -1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert collect(ann.search(df, block_rows=50, query_rows=7)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (-20, [3.0, -0.0]), (20, None)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, score int, rank int")
    assert collect(ann.search(df)) == {0: [(-20, 3.0), (1, 0.5)], -20: [(0, 3.0), (1, 1.5)]}
    assert ann.search(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<double>")
    assert ann.search(one).count() == 0
    assert ann.search(one).columns == ["query_id", "rank", "vec_id", "score"]


def test_heap_order():
    rng = np.random.default_rng(1)
    index = ann.MultiIndex(rng.normal(size=(200, 9)), 7)
    q = rng.normal(size=9)
    cells = index.visit(q, [1] * index.cells, 1e9)
    assert sorted(cells) == list(range(index.cells))
    cost = [-(index.books[0][c // 7] @ q[:4]) - (index.books[1][c % 7] @ q[4:]) for c in cells]
    assert all(a <= b + 1e-12 for a, b in zip(cost, cost[1:]))
