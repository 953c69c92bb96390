"""Queries over the call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import render
from ..operators import rows as R
from ..operators import service as S
from ..plans import tables as T
from ..plans.lineage import cut
from .search import formats_sql


def _starts(spark, d):
    return T.table(spark, d, "supplier").select(F.concat(F.lit("supp#"), F.col("s_suppkey").cast("string")).alias("start_qn"))


_ALL = "starts AS (SELECT concat('supp#', CAST(s_suppkey AS VARCHAR)) AS start_qn FROM supplier)"
_ONE = "starts AS (SELECT 'supp#1' AS start_qn)"


def _levels(starts: str) -> str:
    """Three levels with the cap of 200 nodes a start, as common table expressions."""
    return f"""{T.E}, {starts},
c1 AS (SELECT DISTINCT s.start_qn, e.caller AS q FROM starts s JOIN edges e ON e.callee = s.start_qn WHERE e.caller <> s.start_qn),
l1 AS (SELECT start_qn, q FROM c1 QUALIFY row_number() OVER (PARTITION BY start_qn ORDER BY q) <= 199),
n1 AS (SELECT start_qn, 199 - count(*) AS room FROM l1 GROUP BY start_qn),
c2 AS (SELECT DISTINCT l.start_qn, e.caller AS q FROM l1 l JOIN edges e ON e.callee = l.q WHERE e.caller <> l.start_qn AND (l.start_qn, e.caller) NOT IN (SELECT (start_qn, q) FROM l1)),
r2 AS (SELECT start_qn, q, row_number() OVER (PARTITION BY start_qn ORDER BY q) AS r FROM c2),
l2 AS (SELECT r2.start_qn, q FROM r2 JOIN n1 ON n1.start_qn = r2.start_qn WHERE r <= room),
n2 AS (SELECT n1.start_qn, room - (SELECT count(*) FROM l2 WHERE l2.start_qn = n1.start_qn) AS room FROM n1),
c3 AS (SELECT DISTINCT l.start_qn, e.caller AS q FROM l2 l JOIN edges e ON e.callee = l.q WHERE e.caller <> l.start_qn AND (l.start_qn, e.caller) NOT IN (SELECT (start_qn, q) FROM l1) AND (l.start_qn, e.caller) NOT IN (SELECT (start_qn, q) FROM l2)),
r3 AS (SELECT start_qn, q, row_number() OVER (PARTITION BY start_qn ORDER BY q) AS r FROM c3),
l3 AS (SELECT r3.start_qn, q FROM r3 JOIN n2 ON n2.start_qn = r3.start_qn WHERE r <= room),
nodes AS (SELECT start_qn, start_qn AS qualified_name, 0 AS depth FROM starts UNION ALL SELECT start_qn, q, 1 FROM l1 UNION ALL SELECT start_qn, q, 2 FROM l2 UNION ALL SELECT start_qn, q, 3 FROM l3)"""


_PARTS = "starts AS (SELECT concat('part#', CAST(p_partkey AS VARCHAR)) AS start_qn FROM part)"


def _edges(spark, d):
    """The edges as a stored table, which the levels of a search read."""
    return cut(T.edges(spark, d))


def impact_upstream(spark, d):
    starts = spark.createDataFrame([("supp#1",)], "start_qn string")
    edges = T.calls(spark, d)
    nodes = G.upstream(starts, edges)
    return G.node_details(nodes, T.graph_units(spark, d), edges).where("depth > 0").drop("body_text")


_DETAIL = f"""{T.GU}, one AS (SELECT * FROM graph_units QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY file_path, start_line) = 1),
direct AS (SELECT s.start_qn, e.caller, min(e.call_line) AS call_line FROM starts s JOIN edges e ON e.callee IN (s.start_qn, string_split(s.start_qn, '#')[-1]) GROUP BY 1, 2)"""
_DETAIL_SELECT = """SELECT n.start_qn, n.qualified_name, n.depth, coalesce(o.start_line, 0) AS start_line, coalesce(d.call_line, 0) AS call_line, coalesce(o.file_path, '') AS file_path,
  coalesce(o.signature, '') AS signature, coalesce(o.language, '') AS language{body} FROM nodes n LEFT JOIN one o ON o.qualified_name = n.qualified_name LEFT JOIN direct d ON d.start_qn = n.start_qn AND d.caller = n.qualified_name WHERE n.depth > 0"""


def impact_multi(spark, d):
    return G.upstream(_starts(spark, d), T.calls(spark, d))


def impact_detail(spark, d):
    edges = T.calls(spark, d)
    nodes = G.upstream(_starts(spark, d), edges).where("depth > 0")
    return G.node_details(nodes, T.graph_units(spark, d), edges)


def impact_sizes(spark, d):
    starts = T.table(spark, d, "part").select(F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("start_qn"))
    return G.upstream_sizes(starts, _edges(spark, d))


def impact_report(spark, d):
    nodes = G.upstream(_starts(spark, d), T.calls(spark, d)).where("depth > 0")
    return S.impact_report(nodes).withColumn("display", C.display_name(F.col("start_qn")))


REPORT_SQL = f"""WITH {_levels(_ALL)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY start_qn, depth = 1 ORDER BY depth, qualified_name) AS place FROM nodes WHERE depth > 0),
counts AS (SELECT start_qn, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS indirect FROM nodes WHERE depth > 0 GROUP BY start_qn),
text AS (SELECT start_qn, string_agg(concat('[depth ', CAST(depth AS VARCHAR), '] ', qualified_name), chr(10) ORDER BY depth, qualified_name) AS report FROM ranked WHERE depth = 1 OR place <= 8 GROUP BY start_qn)
SELECT c.start_qn, direct, indirect, report, c.start_qn AS display FROM counts c JOIN text t ON t.start_qn = c.start_qn"""


def impact_context(spark, d):
    starts = _starts(spark, d)
    units = T.graph_units(spark, d)
    edges = T.calls(spark, d)
    nodes = G.node_details(G.upstream(starts, edges).where("depth > 0"), units, edges)
    own = R.first_by(units, ["qualified_name"], "file_path", "start_line").withColumnRenamed("qualified_name", "start_qn").join(starts, "start_qn", "left_semi")
    lang = F.element_at(F.array(*map(F.lit, ["en", "zh", "ja", "xx"])), (F.substring_index("start_qn", "#", -1).cast("int") % 4 + 1).cast("int"))
    return render.impact_context(own, nodes, lang)


def _impact_context_sql():
    return f"""WITH {_levels(_ALL)}, {_DETAIL}, {formats_sql()}, d AS ({_DETAIL_SELECT.format(body='')}),
h AS (SELECT s.start_qn, o.signature, o.file_path, o.start_line, f.* FROM starts s JOIN one o ON o.qualified_name = s.start_qn JOIN formats f ON f.lang = ['en', 'zh', 'ja', 'zh'][CAST(string_split(s.start_qn, '#')[-1] AS INT) % 4 + 1]),
r AS (SELECT d.*, row_number() OVER (PARTITION BY d.start_qn, depth = 1 ORDER BY depth, d.qualified_name) AS place FROM d),
lines AS (SELECT start_qn, 0 AS part, 0 AS place, format(f_changed, signature, file_path, CAST(start_line AS VARCHAR)) AS text FROM h
  UNION ALL SELECT DISTINCT r.start_qn, CASE WHEN depth = 1 THEN 1 ELSE 3 END, 0, CASE WHEN depth = 1 THEN f_direct ELSE f_indirect END FROM r JOIN h ON h.start_qn = r.start_qn
  UNION ALL SELECT r.start_qn, 2, place, format(f_direct_node, r.signature, r.file_path, CAST(r.start_line AS VARCHAR), CASE WHEN call_line > 0 THEN format(f_direct_call, CAST(call_line AS VARCHAR)) ELSE '' END) FROM r JOIN h ON h.start_qn = r.start_qn WHERE depth = 1
  UNION ALL SELECT r.start_qn, 4, place, format(f_indirect_node, CAST(depth AS VARCHAR), r.signature, r.file_path, CAST(r.start_line AS VARCHAR), CASE WHEN call_line > 0 THEN format(f_indirect_call, CAST(call_line AS VARCHAR)) ELSE '' END) FROM r JOIN h ON h.start_qn = r.start_qn WHERE depth > 1 AND place <= 8)
SELECT start_qn, concat(string_agg(text, chr(10) ORDER BY part, place), chr(10)) AS context FROM lines GROUP BY start_qn"""


def reverse_adjacency(spark, d):
    a = G.reverse_adjacency(T.edges(spark, d))
    return a.select("callee", F.size("callers").cast("bigint").alias("n"), F.element_at("callers", 1).alias("first_caller"), F.element_at("callers", -1).alias("last_caller"))


def callers(spark, d):
    nodes = G.upstream(_starts(spark, d), T.edges(spark, d)).where("depth <= 1")
    return G.caller_counts(nodes, T.edges(spark, d))


def new_frontier(spark, d):
    visited = _starts(spark, d).withColumn("qualified_name", F.col("start_qn"))
    return G.next_frontier(visited, T.edges(spark, d), visited)


def lines_to_units(spark, d):
    return G.units_of_hunks(T.blocks(spark, d), T.hunks(spark, d)).select("file_path", "qualified_name", "start_line", "end_line")


LINES_SQL = f"""WITH {T.UB}, {T.H}, whole AS (SELECT file_path FROM hunks GROUP BY file_path HAVING count(r_start) = 0)
SELECT file_path, qualified_name, start_line, end_line FROM blocks b WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file_path = b.file_path AND b.start_line <= h.r_end AND b.end_line >= h.r_start) OR file_path IN (SELECT file_path FROM whole)"""


def affected_names(spark, d):
    return G.units_of_hunks(T.blocks(spark, d), T.hunks(spark, d)).select(F.substring_index("qualified_name", "#", 1).alias("name")).distinct()


def hunk_parse(spark, d):
    ev = T.table(spark, d, "events")
    n, m = F.col("event_id").cast("string"), (F.col("user_id") % 9).cast("string")
    diff = F.concat(F.lit("@@ -1,2 +"), n, F.lit(","), m, F.lit(" @@ f()\n+x\n@@ -9 +"), m, F.lit(" @@\n@@ -5,3 +5,0 @@"))
    return ev.select("event_id", F.posexplode(C.hunk_ranges(diff)).alias("pos", "r")).select("event_id", "pos", "r.r_start", "r.r_end")


HUNK_SQL = r"""WITH t AS (SELECT event_id, concat('@@ -1,2 +', CAST(event_id AS VARCHAR), ',', CAST(user_id % 9 AS VARCHAR), ' @@ f()', chr(10), '+x', chr(10), '@@ -9 +', CAST(user_id % 9 AS VARCHAR), ' @@', chr(10), '@@ -5,3 +5,0 @@') AS diff FROM events),
p AS (SELECT event_id, regexp_extract_all(diff, '@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@', 1) AS s, regexp_extract_all(diff, '@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@', 2) AS c FROM t),
x AS (SELECT event_id, unnest(range(0, len(s))) AS pos, s, c FROM p)
SELECT event_id, CAST(pos AS INT) AS pos, CAST(s[pos + 1] AS INT) AS r_start, CAST(CAST(s[pos + 1] AS INT) + coalesce(TRY_CAST(nullif(c[pos + 1], '') AS INT), 1) AS INT) AS r_end FROM x"""


def diff_union_first(spark, d):
    h = T.hunks(spark, d)
    staged, unstaged = h.where("hunk_id % 2 = 0").withColumn("side", F.lit(0)), h.where("hunk_id % 2 = 1").withColumn("side", F.lit(1))
    both = staged.unionByName(unstaged).withColumn("file_path", C.slashes(F.replace("file_path", F.lit("/en/"), F.lit("\\en\\"))))
    return R.first_by(both, ["file_path"], "side", "hunk_id").select("file_path", "side", "hunk_id")


DIFF_SQL = f"WITH {T.U}, {T.H} SELECT file_path, CAST(hunk_id % 2 AS INT) AS side, hunk_id FROM hunks QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY hunk_id % 2, hunk_id) = 1"

QUERIES = {
    "q_impact_upstream": (impact_upstream, f"WITH {_levels(_ONE)}, {_DETAIL} {_DETAIL_SELECT.format(body='')}"),
    "q_impact_multi": (impact_multi, f"WITH {_levels(_ALL)} SELECT start_qn, qualified_name, depth FROM nodes"),
    "q_impact_detail": (impact_detail, f"WITH {_levels(_ALL)}, {_DETAIL} {_DETAIL_SELECT.format(body=', coalesce(substr(o.body_text, 1, 400), {q}{q}) AS body_text')}".replace("{q}", "'")),
    "q_impact_sizes": (impact_sizes, f"WITH {_levels(_PARTS)} SELECT start_qn, depth, count(*) AS nodes FROM nodes GROUP BY start_qn, depth"),
    "q_impact_report": (impact_report, REPORT_SQL),
    "q_impact_context": (impact_context, _impact_context_sql()),
    "q_reverse_adjacency": (reverse_adjacency, f"WITH {T.E} SELECT callee, count(DISTINCT caller) AS n, min(caller) AS first_caller, max(caller) AS last_caller FROM edges GROUP BY callee"),
    "q_callers": (callers, f"WITH {_levels(_ALL)} SELECT n.start_qn, n.qualified_name, count(DISTINCT e.caller) AS n_callers, min(e.call_line) AS first_line FROM nodes n JOIN edges e ON e.callee = n.qualified_name WHERE n.depth <= 1 GROUP BY 1, 2"),
    "q_new_frontier": (new_frontier, f"WITH {T.E}, {_ALL} SELECT DISTINCT start_qn, caller AS qualified_name FROM starts JOIN edges ON callee = start_qn WHERE caller <> start_qn"),
    "q_lines_to_units": (lines_to_units, LINES_SQL),
    "q_affected_names": (affected_names, f"SELECT DISTINCT string_split(qualified_name, '#')[1] AS name FROM ({LINES_SQL})"),
    "q_hunk_parse": (hunk_parse, HUNK_SQL),
    "q_diff_union_first": (diff_union_first, DIFF_SQL),
}
