"""Top-k over blocks against a scan, and that blocks are left unread."""

import random

import pytest
from pyspark.sql import functions as F

from unitgraph.operators import blocks as B
from unitgraph.operators import retrieval as R

SCHEMA = "collection string, id bigint, vector array<float>, label int"


def clustered(n, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(12)]
    rows = []
    for k in range(n):
        c = centres[k % 12]
        rows.append((rng.choice(["a", "b"]), k, [x + rng.gauss(0, 0.2) for x in c], k % 12 if k % 50 else None))
    return rows


@pytest.mark.parametrize("low,high", [(None, None), (3, None), (5, 5), (20, 30)])
@pytest.mark.parametrize("k", [1, 15, 5000])
def test_as_a_scan(spark, low, high, k):
    rows = clustered(600)
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(q, r[0], r[2]) for q, r in enumerate(rows[:9])] + [(77, "nowhere", [1.0] * 8)], "query_id bigint, collection string, query array<float>")
    built = B.build(vectors, 64, "label")
    got, shares = B.topk(built, queries, k, low, high)
    where = (F.col("label") >= low if low is not None else F.lit(True)) & (F.col("label") <= high if high is not None else F.lit(True))
    want = R.vector_topk(vectors, queries, k, where)
    columns = ["query_id", "collection", "id", "score", "rank"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    read = shares.agg(F.sum("rows_read"), F.sum("rows")).first()
    assert shares.count() == 10 and (k > 15 or read[0] < 0.5 * read[1])


def test_odd_vectors(spark):
    rows = [("a", k, [float(k), 1.0, 0.0], k) for k in range(30)] + [("a", 100, None, 1), ("a", 101, [1.0], 1), ("a", 102, [float("nan")] * 3, 1), ("a", 103, [None, 1.0, 2.0], 1), ("a", 104, [], 1), ("a", 105, [0.0] * 3, 1), ("a", 5, [5.0, 1.0, 0.0], 5), ("c", 1, [None], 1)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (2, "a", [-1.0, 2.0, 5.0]), (3, "a", [0.0] * 3), (4, "c", [1.0])], "query_id bigint, collection string, query array<float>")
    got, _ = B.topk(B.build(vectors, 4), queries, 7)
    want = R.vector_topk(vectors.where("vector is not null"), queries, 7)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, "a", [1.0])], "query_id bigint, collection string, query array<float>")
    got, shares = B.topk(B.build(none), queries, 3)
    assert got.count() == 0 and [tuple(r) for r in shares.collect()] == [(1, "a", 0, 0)]
