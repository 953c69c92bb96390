"""Queries over tables that are changed in place, and over the state that a stream accumulates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import service as S
from ..plans import tables as T
from ..plans.lineage import cut, new_folder
from ..plans.store import FILE, Store
from ..sources import diffs
from ..streaming import state

UNITS = "repo_id bigint, file_path string, qualified_name string, hash string"
EDGES = "repo_id bigint, file_path string, caller string, callee string, call_line int"


def _stored(spark, d):
    """A store of older units and edges, brought up to date: files of one kind are new, of another changed, of a third gone."""
    unit = T.units(spark, d)
    kind = F.col("unit_id") % 10
    units = unit.select(F.col("repo_id").cast("bigint").alias("repo_id"), "file_path", "qualified_name", "hash", kind.alias("kind"))
    # the store reads them several times
    calls = cut(T.edges(spark, d)).select((F.length("caller") % 5).cast("bigint").alias("repo_id"), F.col("caller").alias("file_path"), "caller", "callee", "call_line", F.try_to_number(F.substring_index("caller", "#", -1), F.lit("9999999999999999")).cast("bigint").alias("n"))
    store = Store(spark, new_folder(spark), {"units": UNITS, "edges": EDGES}, buckets=32)
    first_units, first_edges = units.where("kind <> 3").withColumn("hash", F.when(F.col("kind") == 1, "old").otherwise(F.col("hash"))), calls.where("n % 7 <> 2")
    store.replace(units.where("kind <> 3").select(*FILE).union(calls.select(*FILE)), {"units": first_units, "edges": first_edges})
    store.replace(units.where("kind in (1, 3, 7)").select(*FILE), {"units": units.where("kind in (1, 3)")}, ("query", 0))
    changed = calls.where("n % 7 in (2, 4, 6)")
    store.replace(changed.select(*FILE), {"edges": changed.where("n % 7 <> 6").withColumn("call_line", F.col("call_line") + 100)}, ("query", 1))
    return store


def store_units(spark, d):
    return _stored(spark, d).read("units")


def store_edges(spark, d):
    return _stored(spark, d).read("edges").select("repo_id", "caller", "callee", "call_line")


STORE_EDGES = f"""WITH {T.E} SELECT CAST(length(caller) % 5 AS BIGINT) AS repo_id, caller, callee, CASE WHEN n % 7 IN (2, 4) THEN call_line + 100 ELSE call_line END AS call_line
FROM (SELECT *, CAST(regexp_extract(caller, '#(.*)', 1) AS BIGINT) AS n FROM edges) WHERE n % 7 <> 6"""


def change_state(spark, d):
    """The events as a stream of changes and clears; what the keyed state holds behind its last batch."""
    path, checkpoint = f"{d}/events.parquet", new_folder(spark)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    clear = (F.col("event_type") == "signup") & (F.col("event_id") % 40 == 0)
    name = F.concat(F.lit("m"), (F.col("event_id") % 101).cast("string"))
    operations = stream.select(
        (F.col("user_id") % 20).alias("repo_id"), F.when(clear, "clear").otherwise("set").alias("op"), F.col("event_id").alias("seq"), name.alias("qualified_name"),
        F.concat(F.lit("src/File"), F.col("user_id").cast("string")).alias("file_path"), name.alias("name"), F.col("event_type").alias("change"),
    )
    query = state.accumulate(operations).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.accumulated(spark, checkpoint)


CHANGE_STATE = """WITH o AS (SELECT user_id % 20 AS repo_id, event_type = 'signup' AND event_id % 40 = 0 AS clear, event_id AS seq, concat('m', CAST(event_id % 101 AS VARCHAR)) AS name, concat('src/File', CAST(user_id AS VARCHAR)) AS file_path, event_type FROM events),
c AS (SELECT repo_id, max(seq) AS cleared FROM o WHERE clear GROUP BY 1)
SELECT o.repo_id, name AS qualified_name, arg_max(file_path, seq) AS file_path, name, arg_max(event_type, seq) AS change, max(seq) AS seq
FROM o LEFT JOIN c ON c.repo_id = o.repo_id WHERE NOT clear AND seq > coalesce(cleared, -1) GROUP BY o.repo_id, name"""

def _scans(spark, d):
    unit = T.units(spark, d).select("repo_id", "file_path", "qualified_name", (F.col("unit_id") % 5).alias("scan_id"))
    repo = unit.select("repo_id").distinct()
    scans = repo.select("repo_id", F.when(F.col("repo_id") % 3 == 0, 3).when(F.col("repo_id") % 3 == 1, 9).otherwise(4).cast("bigint").alias("scan_id"), (F.col("repo_id") % 7 == 0).alias("force"))
    vectors = T.table(spark, d, "embeddings").groupBy(F.col("label").alias("repo_id")).agg(F.count("*").alias("n"))
    return unit, scans, vectors


def scan_summary(spark, d):
    return S.scan_summary(*_scans(spark, d))


def units_to_embed(spark, d):
    return S.units_to_embed(*_scans(spark, d)).select("repo_id", "file_path", "scan_id")


_SCANS = f"""WITH {T.U}, s AS (SELECT DISTINCT repo_id, CAST(CASE repo_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 9 ELSE 4 END AS BIGINT) AS since, repo_id % 7 = 0 AS forced FROM units),
v AS (SELECT label AS repo_id, count(*) AS n FROM embeddings GROUP BY 1), j AS (SELECT u.repo_id, file_path, unit_id % 5 AS scan_id, since, forced, coalesce(n, 0) AS n FROM units u JOIN s USING (repo_id) LEFT JOIN v USING (repo_id)),
m AS (SELECT repo_id, since, forced OR (count(*) FILTER (scan_id >= since) = 0 AND n = 0) AS rebuild, count(*) FILTER (scan_id >= since) AS a, count(*) AS b,
  count(DISTINCT file_path) FILTER (scan_id >= since) AS c, count(DISTINCT file_path) AS e FROM j GROUP BY repo_id, since, forced, n)"""
SCAN_SUMMARY = _SCANS + " SELECT repo_id, since AS scan_id, CASE WHEN rebuild THEN b ELSE a END AS updated_units, CASE WHEN rebuild THEN e ELSE c END AS updated_files, CASE WHEN rebuild THEN 'rebuild' WHEN a > 0 THEN 'updated' ELSE 'none' END AS mode FROM m"
TO_EMBED = _SCANS + " SELECT j.repo_id, file_path, scan_id FROM j JOIN m USING (repo_id) WHERE rebuild OR scan_id >= j.since"


def diff_source(spark, d):
    """The events as diffs of many sources, one text each, and the changed files that they name."""
    ev = T.table(spark, d, "events")
    path = F.concat(F.lit("src/F"), (F.col("event_id") % 997).cast("string"), F.element_at(F.array(*map(F.lit, [".java", ".js", ".txt"])), (F.col("event_id") % 997 % 3 + 1).cast("int")))
    kind = F.when(F.col("event_type") == "signup", "new file mode 100644\n").when(F.col("event_type") == "error", "deleted file mode 100644\n").otherwise("")
    after = F.when(F.col("event_type") == "error", "/dev/null").otherwise(F.concat(F.lit("b/"), path))
    before = F.when(F.col("event_type") == "signup", "/dev/null").otherwise(F.concat(F.lit("a/"), path))
    header = F.concat(F.lit("@@ -1,2 +"), (F.col("event_id") % 50 + 1).cast("string"), F.lit(","), (F.col("user_id") % 9).cast("string"), F.lit(" @@ f\n+x\n@@ -9 +"), (F.col("event_id") % 50 + 90).cast("string"), F.lit(" @@\n-y\n"))
    part = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), kind, F.lit("--- "), before, F.lit("\n+++ "), after, F.lit("\n"), header)
    texts = ev.groupBy(F.col("user_id").alias("ordinal")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", part.alias("part")))), lambda x: x["part"]), "").alias("diff"))
    changed = diffs.changed_files(texts)
    first, last = F.element_at("line_ranges", 1), F.element_at("line_ranges", -1)
    return changed.select("file_path", "language", "change_type", F.size("line_ranges").cast("bigint").alias("n_ranges"), first["r_start"].cast("bigint").alias("first_start"), first["r_end"].cast("bigint").alias("first_end"), last["r_end"].cast("bigint").alias("last_end"))


DIFF_SOURCE = """WITH e AS (SELECT *, concat('src/F', CAST(event_id % 997 AS VARCHAR), ['.java', '.js', '.txt'][CAST(event_id % 997 % 3 + 1 AS INT)]) AS file_path FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY user_id, event_id) = 1)
SELECT file_path, CASE WHEN file_path LIKE '%.js' THEN 'javascript' ELSE 'java' END AS language, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, CAST(2 AS BIGINT) AS n_ranges,
  event_id % 50 + 1 AS first_start, event_id % 50 + 1 + user_id % 9 AS first_end, event_id % 50 + 91 AS last_end FROM f WHERE file_path NOT LIKE '%.txt'"""

QUERIES = {
    "q_scan_summary": (scan_summary, SCAN_SUMMARY),
    "q_units_to_embed": (units_to_embed, TO_EMBED),
    "q_diff_source": (diff_source, DIFF_SOURCE),
    "q_store_units": (store_units, f"WITH {T.U} SELECT CAST(repo_id AS BIGINT) AS repo_id, file_path, qualified_name, hash FROM units WHERE unit_id % 10 <> 7"),
    "q_store_edges": (store_edges, STORE_EDGES),
    "q_change_state": (change_state, CHANGE_STATE),
}
