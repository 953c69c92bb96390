"""Units touched by ranges, against every pair; crowded files in little time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from unitgraph.operators import graph as G


@pytest.mark.parametrize("exact_end", [False, True])
def test_every_pair(spark, exact_end):
    rng = random.Random(6)
    span = lambda: (lambda a, n: (a, a + n))(rng.randrange(1, 4000), rng.choice([0, 1, 5, 15, 16, 17, 200, 3000]))
    units = [(rng.choice(["a.js", "b\\c.js", "d.js"]), f"u{k}", *span()) for k in range(300)] + [("a.js", "none", None, 4), ("z.js", "z", 1, 2), ("a.js", "u0", 1, 1), ("a.js", "u0", 1, 1)]
    hunks = [(rng.choice(["a.js", "b/c.js"]), *span()) for _ in range(25)] + [("d.js", None, None), ("a.js", 5, 5), ("a.js", 5, 5), ("q.js", 1, 2)]
    u = spark.createDataFrame(units, "file_path string, qualified_name string, start_line int, end_line int")
    h = spark.createDataFrame(hunks, "file_path string, r_start int, r_end int")
    got = sorted(map(tuple, G.units_of_hunks(u, h, exact_end).collect()), key=repr)
    hit = lambda p, a, b: a is not None and any(q == p and s is not None and a <= e - exact_end and b >= s for q, s, e in hunks)
    want = sorted((r for r in units if r[0] == "d.js" or hit(r[0].replace("\\", "/"), r[2], r[3])), key=repr)
    assert got == want and 50 < len(want) < len(units)


def test_a_crowded_file(spark):
    n = 100_000
    units = spark.range(n).select(F.lit("a").alias("file_path"), F.col("id").cast("string").alias("qualified_name"), (F.col("id") * 10).cast("int").alias("start_line"), (F.col("id") * 10 + 4).cast("int").alias("end_line"))
    hunks = spark.range(n).select(F.lit("a").alias("file_path"), (F.col("id") * 10 + 5 + F.when(F.col("id") % 1000 == 0, 5).otherwise(0)).cast("int").alias("r_start"))
    began = time.time()
    got = G.units_of_hunks(units, hunks.withColumn("r_end", F.col("r_start") + 2)).count()
    assert got == n // 1000 and time.time() - began < 60
