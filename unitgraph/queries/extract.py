"""Queries of extraction: markup rules over pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import rows as R
from ..plans import tables as T

_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)((?: [^<>]*)?)>"
_LEAF = r">([^<>]+)</"


def _tags(spark, d):
    p = T.table(spark, d, "pages")
    return p.select("page_id", F.posexplode(M.matches(F.col("html"), _TAG, 1, 2)).alias("pos", "t")).select("page_id", "pos", F.col("t.g1").alias("tag"), F.col("t.g2").alias("attrs"))


_TAGS = rf"""found AS (SELECT page_id, regexp_extract_all(html, '{_TAG}', 1) AS a, regexp_extract_all(html, '{_TAG}', 2) AS b FROM pages),
idx AS (SELECT page_id, unnest(range(0, len(a))) AS pos, a, b FROM found), tags AS (SELECT page_id, CAST(pos AS INT) AS pos, a[pos + 1] AS tag, b[pos + 1] AS attrs FROM idx)"""


def tag_extract(spark, d):
    """Distinct tags of a page (by name and 30 characters of attributes) at their first place, with the number of attributes."""
    t = _tags(spark, d).withColumn("short", F.substring("attrs", 1, 30))
    first = R.first_by(t, ["page_id", "tag", "short"], "pos")
    return first.select("page_id", "tag", "short", "pos", F.size(M.attributes(F.col("attrs"))).cast("int").alias("n_attrs"))


TAG_SQL = rf"""WITH {_TAGS} SELECT page_id, tag, substr(attrs, 1, 30) AS short, pos, CAST(len(list_distinct(regexp_extract_all(attrs, '(\w+)=["'']([^"'']*)["'']', 1))) AS INT) AS n_attrs FROM tags QUALIFY row_number() OVER (PARTITION BY page_id, tag, substr(attrs, 1, 30) ORDER BY pos) = 1"""


def comment_strip(spark, d):
    p = T.table(spark, d, "pages")
    return p.select("page_id", F.md5(M.strip_comments(F.col("html"), "<!--", "-->")).alias("stripped_md5"))


def name_counter(spark, d):
    t = _tags(spark, d).select("page_id", "pos", F.col("tag").alias("name"))
    return R.numbered_names(t, ["page_id"], "name", "pos")


def leaf_limit(spark, d):
    p = T.table(spark, d, "pages")
    leaves = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LEAF), F.lit(1))).alias("pos", "text")).where(F.trim("text") != "")
    w = Window.partitionBy("page_id").orderBy("pos")
    return leaves.withColumn("_n", F.row_number().over(w)).where("_n <= 100").select("page_id", "pos", F.md5("text").alias("text_md5"))


LEAF_SQL = rf"""WITH f AS (SELECT page_id, regexp_extract_all(html, '{_LEAF}', 1) AS a FROM pages), x AS (SELECT page_id, unnest(range(0, len(a))) AS pos, a FROM f),
l AS (SELECT page_id, CAST(pos AS INT) AS pos, a[pos + 1] AS text FROM x) SELECT page_id, pos, md5(text) AS text_md5 FROM l WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 100"""


def el_distinct(spark, d):
    p = T.table(spark, d, "pages")
    values = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('="([^"]*)"'), F.lit(1))).alias("pos", "value"))
    return values.groupBy("page_id", "value").agg(F.min("pos").alias("first_pos"))


EL_SQL = """WITH f AS (SELECT page_id, regexp_extract_all(html, '="([^"]*)"', 1) AS a FROM pages), x AS (SELECT page_id, unnest(range(0, len(a))) AS pos, a FROM f)
SELECT page_id, a[pos + 1] AS value, CAST(min(pos) AS INT) AS first_pos FROM x GROUP BY page_id, a[pos + 1]"""


def json_roundtrip(spark, d):
    ev = T.table(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    answer = F.when(F.col("event_id") % 5 == 0, F.lit("no json {")).otherwise(
        F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("summary"), F.array_repeat(F.col("event_type"), (F.col("event_id") % 8).cast("int")).alias("tags"))), F.lit("\n```"))
    )
    parsed = M.llm_answer(answer)
    return ev.select("event_id", k.alias("k"), parsed["summary"].alias("summary"), F.size(parsed["tags"]).cast("bigint").alias("n_tags"))


JSON_SQL = """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 5 = 0 THEN '' ELSE substr(concat(event_type, ' ', props), 1, 100) END AS summary,
  CASE WHEN event_id % 5 = 0 THEN CAST(0 AS BIGINT) ELSE least(5, event_id % 8) END AS n_tags FROM events"""


def event_frames(spark, d):
    ev = T.table(spark, d, "events")
    body = F.concat(F.lit("data: "), "props", F.lit("\n\n: ping\n\ndata: {bad\n\ndata:"), F.to_json(F.struct(F.col("user_id"))), F.lit("\n\n"))
    return ev.select("event_id", F.size(M.event_frames(body)).cast("bigint").alias("frames"), F.element_at(M.event_frames(body), -1).alias("last"))


QUERIES = {
    "q_tag_extract": (tag_extract, TAG_SQL),
    "q_comment_strip": (comment_strip, "SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS stripped_md5 FROM pages"),
    "q_name_counter": (name_counter, f"WITH {_TAGS} SELECT page_id, pos, CASE WHEN row_number() OVER w > 1 THEN concat(tag, '_', CAST(row_number() OVER w - 1 AS VARCHAR)) ELSE tag END AS name FROM tags WINDOW w AS (PARTITION BY page_id, tag ORDER BY pos)"),
    "q_leaf_limit": (leaf_limit, LEAF_SQL),
    "q_el_distinct": (el_distinct, EL_SQL),
    "q_json_roundtrip": (json_roundtrip, JSON_SQL),
    "q_event_frames": (event_frames, "SELECT event_id, CAST(2 AS BIGINT) AS frames, concat('{\"user_id\":', CAST(user_id AS VARCHAR), '}') AS last FROM events"),
}
