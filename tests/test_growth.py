"""Work a row, rows a step: what kept queries from growing with their tables."""

import random

from pyspark.sql import functions as F

from unitgraph.functions import columns as C
from unitgraph.operators import graph as G
from unitgraph.plans.lineage import spread


def test_callers_of_shared_nodes_are_counted_once(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"a.B#c{rng.randrange(9)}", rng.choice(["p.Q#longname", "longname", "x.Y#z", "z"]), rng.randint(1, 50)) for _ in range(80)], "caller string, callee string, call_line int")
    nodes = spark.createDataFrame([(f"s{i}", n) for i in range(30) for n in ("p.Q#longname", "x.Y#z", "un.C#alled")], "start_qn string, qualified_name string")
    want = G.callers_of(nodes, edges).groupBy("start_qn", "qualified_name").agg(F.count("*").alias("n_callers"), F.min("call_line").alias("first_line"))
    assert sorted(map(tuple, G.caller_counts(nodes, edges).collect())) == sorted(map(tuple, want.collect())) and want.count() == 60
    names = nodes.select("qualified_name").distinct()
    assert G.callers_of(names.withColumn("start_qn", F.col("qualified_name")), edges).count() * 30 == G.callers_of(nodes, edges).count()


def test_sets_of_one_start_and_of_many(spark):
    masks = [1 << k for k in range(63)] + [-(1 << 63), -1, 5, (1 << 62) | 1, -(1 << 63) | 8]
    rows = spark.createDataFrame([(m, str(i), 0) for i, m in enumerate(masks)], "mask bigint, qualified_name string, chunk bigint")
    got = {}
    for r in G._unpacked(rows, "qualified_name").collect():
        got.setdefault(int(r.qualified_name), set()).add(r.bit)
    assert got == {i: {k for k in range(64) if m >> k & 1} for i, m in enumerate(masks)}


def test_small_tables_meet_all_cores(spark):
    table = spark.range(1000).withColumnRenamed("id", "k").coalesce(1)
    sizes = spread(table, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 250


def test_paths_are_compared_without_lambdas(spark):
    """A lambda over a list would find the lower-cased path anew for each entry."""
    rows = spark.createDataFrame([("a/JQuery.min.js", 1), ("src/static/lib/x.js", 1), ("src/Ring.java", 10**7), ("src/Ring.java", 1), ("src/x.txt", 10**7), (None, 1)], "path string, size bigint")
    found = rows.select(C.third_party(F.col("path"), C.language_of(F.col("path")), F.col("size")).alias("t"))
    assert [r.t for r in found.collect()] == [True, True, True, False, False, None]
    assert "lambda" not in found._jdf.queryExecution().analyzed().toString()


def test_sizes_are_counted_without_ranking(spark):
    """Sizes of crowded and other starts are those of the rows, and no start is ranked for them."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(f"n{rng.randrange(90)}", f"n{rng.randrange(40)}", 1) for _ in range(500)], "caller string, callee string, call_line int")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(70)], "start_qn string")
    settings = C.DEFAULT.__class__(max_nodes=14)
    sizes = G.upstream_sizes(starts, edges, settings)
    rows = G.upstream(starts, edges, settings).groupBy("start_qn", "depth").agg(F.count("*").alias("nodes"))
    assert sizes.dtypes == rows.dtypes and sorted(map(tuple, sizes.collect())) == sorted(map(tuple, rows.collect()))
    assert "Window" not in sizes._jdf.queryExecution().toString()


def test_impact_texts_deal_nodes_by_start_once(spark):
    """A report ranks and groups a start's nodes behind one exchange, and a context deals its nodes once and doubles none but the first of a kind."""
    from unitgraph.operators import render, service

    nodes = spark.range(400).selectExpr("concat('s', id % 4) AS start_qn", "concat('n', id) AS qualified_name", "CAST(id % 3 + 1 AS INT) AS depth", "CAST(id % 2 AS INT) AS call_line", "'f' AS file_path", "1 AS start_line", "'sig' AS signature")
    report = service.impact_report(nodes)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.start_qn, r.direct, r.indirect, len(r.report.split("\n"))) for r in report.collect()} == {(f"s{k}", d, 100 - d, d + 8) for k in range(4) for d in [len([i for i in range(400) if i % 4 == k and i % 3 == 0])]}
    changed = spark.range(4).selectExpr("concat('s', id) AS start_qn", "'sig' AS signature", "'f' AS file_path", "1 AS start_line")
    plan = render.impact_context(changed, nodes, F.lit("en"))._jdf.queryExecution().executedPlan().toString()
    assert "_direct" not in "".join(line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_details_take_repeated_calls_and_run_no_job_while_planned(spark):
    """Calls that come several times are grouped with what is taken from them; names are counted by no job of their own."""
    edges = spark.createDataFrame([("a", "x#s", 7), ("a", "x#s", 3), ("b", "a", 5), ("b", "a", 5)], "caller string, callee string, call_line int")
    starts = spark.createDataFrame([("x#s",)], "start_qn string")
    nodes = G.upstream(starts, edges).where("depth > 0")
    units = spark.createDataFrame([("a", "f", 1, "sig", "java", "body")], "qualified_name string, file_path string, start_line int, signature string, language string, body_text string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("details", "planning only")
    try:
        details = G.node_details(nodes, units, edges)
        assert not jobs.getJobIdsForGroup("details")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {(r.qualified_name, r.depth, r.call_line, r.file_path) for r in details.collect()} == {("a", 1, 3, "f"), ("b", 2, 0, "")}
