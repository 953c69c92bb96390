"""The model's tables, read from the driver tables: units, blocks, edges, hunks, events, vectors.

Each has its SQL twin (for DuckDB) beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("unit_id"), F.substring("source", 4, 9).cast("int").alias("repo_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file_path"),
        F.col("lang").alias("language"), F.concat("source", F.lit("."), "lang", F.lit("#doc"), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.substring(text, 1, 80).alias("signature"), F.lit(1).alias("start_line"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("end_line"), text.alias("body_text"), F.md5("text").alias("hash"),
    )


U = """units AS (SELECT doc_id AS unit_id, CAST(substr(source, 4) AS INT) AS repo_id, concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR)) AS file_path, lang AS language,
  concat(source, '.', lang, '#doc', CAST(doc_id AS VARCHAR)) AS qualified_name, concat('doc', CAST(doc_id AS VARCHAR)) AS name, substr(text, 1, 80) AS signature, 1 AS start_line,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS end_line, text AS body_text, md5(text) AS hash FROM documents)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Units of five lines each."""
    u = units(spark, d).select("file_path", "end_line")
    cut = u.select("file_path", "end_line", F.explode(F.sequence(F.lit(0), F.floor((F.col("end_line") - 1) / 5).cast("int"))).alias("k"))
    return cut.select("file_path", F.concat("file_path", F.lit("#b"), F.col("k").cast("string")).alias("qualified_name"), (5 * F.col("k") + 1).cast("int").alias("start_line"), F.least(5 * F.col("k") + 5, F.col("end_line")).cast("int").alias("end_line"))


UB = f"""{U}, cut AS (SELECT file_path, end_line, unnest(range(0, CAST(floor((end_line - 1) / 5) AS BIGINT) + 1)) AS k FROM units),
blocks AS (SELECT file_path, concat(file_path, '#b', CAST(k AS VARCHAR)) AS qualified_name, CAST(5 * k + 1 AS INT) AS start_line, CAST(least(5 * k + 5, end_line) AS INT) AS end_line FROM cut)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls: customer -> order -> part -> supplier."""
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    name = lambda kind, c: F.concat(F.lit(f"{kind}#"), F.col(c).cast("string"))
    # grouped by the numbers, which are shorter than the names
    calls = lambda a, b: li.groupBy(a, b).agg(F.min("l_linenumber").cast("int").alias("call_line"))
    return (
        calls("l_partkey", "l_suppkey").select(name("part", "l_partkey").alias("caller"), name("supp", "l_suppkey").alias("callee"), "call_line")
        .union(calls("l_orderkey", "l_partkey").select(name("order", "l_orderkey"), name("part", "l_partkey"), "call_line"))
        .union(orders.select(name("cust", "o_custkey"), name("order", "o_orderkey"), F.lit(0)))
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """:func:`edges` before they are grouped: a call may come several times. For steps that group what they take from it themselves."""
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    name = lambda kind, c: F.concat(F.lit(f"{kind}#"), F.col(c).cast("string"))
    line = F.col("l_linenumber").cast("int").alias("call_line")
    return (
        li.select(name("part", "l_partkey").alias("caller"), name("supp", "l_suppkey").alias("callee"), line)
        .union(li.select(name("order", "l_orderkey"), name("part", "l_partkey"), line))
        .union(orders.select(name("cust", "o_custkey"), name("order", "o_orderkey"), F.lit(0)))
    )


E = """edges AS (SELECT concat('part#', CAST(l_partkey AS VARCHAR)) AS caller, concat('supp#', CAST(l_suppkey AS VARCHAR)) AS callee, CAST(min(l_linenumber) AS INT) AS call_line FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT concat('order#', CAST(l_orderkey AS VARCHAR)), concat('part#', CAST(l_partkey AS VARCHAR)), CAST(min(l_linenumber) AS INT) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT concat('cust#', CAST(o_custkey AS VARCHAR)), concat('order#', CAST(o_orderkey AS VARCHAR)), 0 FROM orders)"""


def graph_units(spark: SparkSession, d: str) -> DataFrame:
    """Details of the graph's nodes: suppliers, parts, orders; customers have none, parts have two."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}#"), F.col(c).cast("string"))

    def rows(df, qn, path, sig, lang, body):
        return df.select(qn.alias("qualified_name"), path.alias("file_path"), F.lit(3).alias("start_line"), F.lit(9).alias("end_line"), sig.alias("signature"), F.lit(lang).alias("language"), body.alias("body_text"))

    s, p, o = table(spark, d, "supplier"), table(spark, d, "part"), table(spark, d, "orders")
    return (
        rows(s, name("supp", "s_suppkey"), F.col("s_name"), F.col("s_name"), "java", F.col("s_name"))
        .union(rows(p, name("part", "p_partkey"), F.col("p_brand"), F.col("p_name"), "java", F.col("p_type")))
        .union(rows(p, name("part", "p_partkey"), F.lit("zz"), F.lit("overload"), "java", F.lit("")))
        .union(rows(o, name("order", "o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), "jsp", F.col("o_orderpriority")))
    )


GU = """graph_units AS (SELECT concat('supp#', CAST(s_suppkey AS VARCHAR)) AS qualified_name, s_name AS file_path, 3 AS start_line, 9 AS end_line, s_name AS signature, 'java' AS language, s_name AS body_text FROM supplier
  UNION ALL SELECT concat('part#', CAST(p_partkey AS VARCHAR)), p_brand, 3, 9, p_name, 'java', p_type FROM part
  UNION ALL SELECT concat('part#', CAST(p_partkey AS VARCHAR)), 'zz', 3, 9, 'overload', 'java', '' FROM part
  UNION ALL SELECT concat('order#', CAST(o_orderkey AS VARCHAR)), o_orderpriority, 3, 9, o_orderstatus, 'jsp', o_orderpriority FROM orders)"""


def hunks(spark: SparkSession, d: str) -> DataFrame:
    """Changed ranges of files, from the events; 'error' events name a file without ranges."""
    ev = table(spark, d, "events")
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))  # one row
    known = units(spark, d).select("unit_id", "file_path")
    h = ev.join(F.broadcast(n)).select(
        F.col("event_id").alias("hunk_id"), ((F.col("event_id") * 7) % F.col("n")).alias("unit_id"), (F.col("event_type") != "error").alias("has_range"),
        (F.col("user_id") % 20 + 1).cast("int").alias("s"), (F.col("user_id") % 20 + 1 + F.col("user_id") % 7).cast("int").alias("e"),
    )
    return h.join(known, "unit_id").select("hunk_id", "file_path", F.when(F.col("has_range"), F.col("s")).alias("r_start"), F.when(F.col("has_range"), F.col("e")).alias("r_end"))


H = """hunks AS (SELECT event_id AS hunk_id, file_path, CASE WHEN event_type <> 'error' THEN CAST(user_id % 20 + 1 AS INT) END AS r_start,
  CASE WHEN event_type <> 'error' THEN CAST(user_id % 20 + 1 + user_id % 7 AS INT) END AS r_end
  FROM events JOIN units ON unit_id = (event_id * 7) % (SELECT count(*) FROM documents))"""


def watch_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.concat(F.lit("src/File"), F.col("user_id").cast("string"), F.lit(".java")).alias("path"), kind.alias("kind"), "event_type", "value")


EV = """ev AS (SELECT event_id AS seq, ts, user_id, concat('src/File', CAST(user_id AS VARCHAR), '.java') AS path,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, event_type, value FROM events)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Collection 'signatures' is the embedding, 'context' its first half."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    return e.select(F.lit("signatures").alias("collection"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")).union(
        e.select(F.lit("context"), "vec_id", "label", F.slice("embedding", 1, 32))
    )


V = """vectors AS (SELECT 'signatures' AS collection, vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE embedding IS NOT NULL
  UNION ALL SELECT 'context', vec_id, label, CAST(embedding[1:32] AS DOUBLE[]) FROM embeddings WHERE embedding IS NOT NULL)"""
