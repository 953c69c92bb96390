"""Queries over cache, reports, status, progress and bursts of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import service as S
from ..plans import tables as T


def cache_overlay(spark, d):
    hits = T.table(spark, d, "documents").select("doc_id", "lang")
    cache = T.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("error").alias("status"), F.col("toxic").alias("tag"))
    return S.cache_overlay(hits, cache, ["doc_id"])


def cache_misses(spark, d):
    hits = T.table(spark, d, "documents").select("doc_id")
    cache = T.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("error").alias("status"))
    return S.cache_misses(hits, cache, ["doc_id"])


def recent_reports(spark, d):
    return S.recent(T.table(spark, d, "conversations").select("conv_id", "turn", "role"), 20, F.desc("conv_id"), F.desc("turn"))


def _reports(spark, d):
    c = T.table(spark, d, "conversations")
    return c.select((F.col("conv_id") % 10).alias("repo_id"), "conv_id", "turn", "text")


def report_log(spark, d):
    r = _reports(spark, d)
    fresh = r.where("turn = 0").withColumn("turn", F.col("turn") + 1000)
    cleared = T.table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("repo_id")).where("repo_id < 3")
    return S.report_log(r, fresh, cleared, "repo_id").select("repo_id", "conv_id", "turn")


def cache_state(spark, d):
    ev = T.table(spark, d, "events")
    kind = F.col("event_type")
    status = F.when((kind == "purchase") & (F.col("event_id") % 3 == 0), "done").when(kind == "error", "error").when(F.col("event_id") % 4 == 1, "pending").otherwise("read")
    return S.cache_state(ev.select("user_id", F.col("event_id").alias("seq"), status.alias("status")), ["user_id"])


STATE_SQL = """WITH l AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'done' WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 1 THEN 'pending' ELSE 'read' END AS status FROM events),
d AS (SELECT user_id, min(seq) AS finished FROM l WHERE status = 'done' GROUP BY user_id),
w AS (SELECT user_id, arg_max(status, (CASE WHEN status = 'done' THEN 1 ELSE 0 END) * 1000000000000 + seq) AS status FROM l WHERE status <> 'read' GROUP BY user_id)
SELECT l.user_id, any_value(w.status) AS status, count(*) FILTER (l.status = 'read' AND l.seq > d.finished) AS hit_count FROM l LEFT JOIN d ON d.user_id = l.user_id LEFT JOIN w ON w.user_id = l.user_id GROUP BY l.user_id"""


def status_lookup(spark, d):
    n = T.table(spark, d, "nation")
    repos = n.select(F.col("n_nationkey").cast("bigint").alias("repo_id"), F.element_at(F.array(F.lit("scanning"), F.lit("done"), F.lit(None).cast("string"), F.lit("error")), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("scan_status"))
    live = T.watch_events(spark, d).where("kind = 'created'").groupBy(F.col("user_id").alias("repo_id")).agg(F.max_by("kind", "seq").alias("live_status"))
    return S.status(repos, live)


STATUS_SQL = f"""WITH {T.EV}, live AS (SELECT user_id AS repo_id, arg_max(kind, seq) AS live_status FROM ev WHERE kind = 'created' GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS repo_id, coalesce(live_status, CASE n_nationkey % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'done' WHEN 3 THEN 'error' END, 'idle') AS status FROM nation LEFT JOIN live ON repo_id = n_nationkey"""


def progress_fold(spark, d):
    ev = T.watch_events(spark, d)
    log = ev.select("user_id", F.col("event_type").alias("phase"), "seq", F.floor("value").cast("bigint").alias("done"), (F.col("seq") % 400).alias("total"))
    return S.progress(log, ["user_id"])


PROGRESS_SQL = """WITH p AS (SELECT user_id, event_type AS phase, count(*) AS events, arg_max(CAST(floor(value) AS BIGINT), event_id) AS done, arg_max(event_id % 400, event_id) AS total FROM events GROUP BY 1, 2)
SELECT *, CAST(CASE WHEN total > 0 THEN least(100, CAST(round(100.0::DOUBLE * done / total) AS INT)) ELSE 0 END AS INT) AS percent FROM p"""


def watch_state(spark, d):
    return S.watch_state(T.watch_events(spark, d).select("user_id", "path", "kind", "seq"), ["user_id", "path"], "seq")


def debounce_sessions(spark, d):
    out = S.debounced(T.watch_events(spark, d))
    return out.select(F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"), "events", F.array_join("paths", ",").alias("paths"))


DEBOUNCE_SQL = f"""WITH {T.EV}, f AS (SELECT ts, seq, path, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, seq) > INTERVAL 1500 MILLISECONDS THEN 1 ELSE 0 END AS new FROM ev),
g AS (SELECT ts, path, sum(new) OVER (ORDER BY ts, seq) AS island FROM f)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(*) AS events, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM g GROUP BY island"""


def gap_merge(spark, d):
    ev = T.watch_events(spark, d).select("user_id", F.floor(F.unix_timestamp("ts") / 60).cast("bigint").alias("s"), (F.floor(F.unix_timestamp("ts") / 60) + F.col("seq") % 50).cast("bigint").alias("e"))
    return S.merged_gaps(ev, ["user_id"], "s", "e", 30).groupBy("user_id", "island").agg(F.min("s").alias("first"), F.max("e").alias("last"), F.count("*").alias("n"))


GAP_SQL = """WITH v AS (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS s, CAST(floor(epoch(ts) / 60) AS BIGINT) + event_id % 50 AS e FROM events),
f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 30 THEN 1 ELSE 0 END AS new FROM v),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS island FROM f)
SELECT user_id, island, min(s) AS first, max(e) AS last, count(*) AS n FROM g GROUP BY 1, 2"""


def removed_units(spark, d):
    old = T.units(spark, d).select("unit_id", "qualified_name")
    new = old.join(T.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id")), "unit_id", "left_semi")
    return R.removed_units(new, old, ["qualified_name"]).select("qualified_name")


def _repos(spark, d):
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("/src/"), "s_name").alias("path"))


def repo_create(spark, d):
    """New repositories by customers, of which some share a path, and some have one that is there."""
    key = F.col("c_custkey")
    path = F.when(key % 3 == 0, F.concat(F.lit("\\src\\"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit("/"))).otherwise(F.concat(F.lit("/new/"), (key % 50).cast("string"), F.lit("//")))
    return S.create_repos(_repos(spark, d), T.table(spark, d, "customer").select(F.col("c_name").alias("name"), path.alias("path")))


REPO_SQL = """WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, concat('/src/', s_name) AS path FROM supplier),
f AS (SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('/src/', replace(c_name, 'Customer', 'Supplier')) ELSE concat('/new/', CAST(c_custkey % 50 AS VARCHAR)) END AS path FROM customer),
n AS (SELECT path, min(name) AS name FROM f WHERE path NOT IN (SELECT path FROM r) GROUP BY path)
SELECT id, name, path FROM r UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY path), name, path FROM n"""


def repo_by_path(spark, d):
    asked = T.table(spark, d, "customer").select(F.concat(F.lit("/src\\"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), F.lit("/")).alias("path"))
    return S.repos_of_paths(_repos(spark, d), asked)


PATH_SQL = """SELECT concat('/src', chr(92), replace(c_name, 'Customer', 'Supplier'), '/') AS path, CAST(s_suppkey AS BIGINT) AS id FROM customer LEFT JOIN supplier ON s_name = replace(c_name, 'Customer', 'Supplier')"""

QUERIES = {
    "q_repo_create": (repo_create, REPO_SQL),
    "q_repo_by_path": (repo_by_path, PATH_SQL),
    "q_cache_overlay": (cache_overlay, "SELECT d.doc_id, d.lang, l.toxic AS tag, l.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id"),
    "q_cache_misses": (cache_misses, "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "q_recent_reports": (recent_reports, "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20"),
    "q_report_log": (report_log, "WITH r AS (SELECT conv_id % 10 AS repo_id, conv_id, turn FROM conversations) SELECT * FROM (SELECT * FROM r UNION ALL SELECT repo_id, conv_id, turn + 1000 FROM r WHERE turn = 0) WHERE repo_id NOT IN (0, 1, 2)"),
    "q_cache_state": (cache_state, STATE_SQL),
    "q_status_lookup": (status_lookup, STATUS_SQL),
    "q_progress_fold": (progress_fold, PROGRESS_SQL),
    "q_watch_state": (watch_state, f"WITH {T.EV} SELECT user_id, path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM ev GROUP BY 1, 2"),
    "q_debounce_sessions": (debounce_sessions, DEBOUNCE_SQL),
    "q_gap_merge": (gap_merge, GAP_SQL),
    "q_removed_units": (removed_units, f"WITH {T.U} SELECT qualified_name FROM units WHERE unit_id NOT IN (SELECT doc_id FROM labels)"),
}
