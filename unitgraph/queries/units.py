"""Queries over units and their upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import retrieval
from ..operators import rows as R
from ..operators import service as S
from ..plans import tables as T
from ..plans.lineage import spread

LANGS = ["en", "fr", "de", "es"]


def _stored(spark, d):
    """An older state: the files that have a label, another hash of those of low quality, and files that are gone since."""
    labels = T.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), "quality")
    u = T.units(spark, d).select("repo_id", "file_path", "unit_id", "hash").join(labels, "unit_id")
    old = u.select("repo_id", "file_path", F.when(F.col("quality") == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"))
    gone = T.table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("repo_id"), F.concat(F.lit("gone/"), "n_name").alias("file_path"), F.md5("n_name").alias("hash"))
    return old.union(gone)


_STORED = f"""{T.U}, stored AS (SELECT repo_id, file_path, CASE WHEN quality = 0 THEN md5(hash) ELSE hash END AS hash FROM units JOIN labels ON doc_id = unit_id
  UNION ALL SELECT CAST(n_regionkey AS INT), concat('gone/', n_name), md5(n_name) FROM nation)"""


def unit_stats(spark, d):
    return S.unit_stats(T.units(spark, d), LANGS)


def units_since(spark, d):
    ev = T.watch_events(spark, d).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return ev.groupBy("kind").agg(F.count("*").alias("units"), F.count_distinct("path").alias("files"))


def embeddable_counts(spark, d):
    u = T.units(spark, d).select("repo_id", C.embeddable(F.lit("method"), F.col("name"), F.col("body_text"), F.lit(0)).alias("ok"))
    return u.groupBy("repo_id").agg(F.count_if("ok").alias("embeddable"), F.count_if(~F.col("ok")).alias("filtered"))


def _paths(spark, d):
    parts = spread(T.table(spark, d, "part"), "p_partkey").select("p_partkey", F.regexp_replace("p_name", " ", "").alias("n"), "p_brand", "p_size")
    folder = F.element_at(F.array(*map(F.lit, ["src/main", "src/Lib", "web\\static\\plugins", "target/x", "app/META-INF/resources"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, [".java", ".JS", ".jsp", ".xml", ".txt", ".min.js"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return parts.select("p_partkey", F.concat(folder, F.lit("/"), "n", suffix).alias("path"), (F.col("p_size") * 20000).cast("bigint").alias("size"))


_PATHS = r"""paths AS (SELECT p_partkey, concat(['src/main', 'src/Lib', 'web\static\plugins', 'target/x', 'app/META-INF/resources'][CAST(p_partkey % 5 + 1 AS INT)], '/', replace(p_name, ' ', ''),
  ['.java', '.JS', '.jsp', '.xml', '.txt', '.min.js'][CAST(p_partkey % 6 + 1 AS INT)]) AS path, CAST(p_size * 20000 AS BIGINT) AS size FROM part)"""


def scan_filter(spark, d):
    p = _paths(spark, d).withColumn("language", C.language_of(F.col("path")))
    return p.select("p_partkey", "path", "language", C.in_skipped_folder(F.col("path")).alias("skipped_folder"), F.coalesce(C.third_party(F.col("path"), F.col("language"), F.col("size")), F.lit(False)).alias("third_party"))


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SUFFIX = r"regexp_extract(lower(string_split(replace(path, '\', '/'), '/')[-1]), '[^/](\.[^./]*)$', 1)"
_LANGUAGE = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in C.LANGUAGES.items()) + " END"

SCAN_SQL = rf"""WITH {_PATHS}, known AS (SELECT *, {_LANGUAGE} AS language FROM paths)
SELECT p_partkey, path, language, list_has_any(string_split(lower(replace(path, '\', '/')), '/'), {_sql_list(C.SKIP_DIRS)}) AS skipped_folder,
  (len(list_filter({_sql_list(C.SKIP_NAMES)}, lambda k: contains(lower(string_split(replace(path, '\', '/'), '/')[-1]), k))) > 0
   OR len(list_filter({_sql_list(C.SKIP_FRAGMENTS)}, lambda k: contains(lower(replace(path, '\', '/')), k))) > 0
   OR coalesce((language IN ('javascript', 'jsp') AND size > 512000) OR (language = 'java' AND size > 5242880), false)) AS third_party FROM known"""


def watch_path_filter(spark, d):
    return _paths(spark, d).select("path", C.watched(F.col("path")).alias("watched"))


WATCH_SQL = rf"""WITH {_PATHS} SELECT path, ({_LANGUAGE} IS NOT NULL AND NOT list_has_any(string_split(lower(replace(path, '\', '/')), '/'), {_sql_list(C.WATCH_SKIP_DIRS)})) AS watched FROM paths"""

_KEYS = ["repo_id", "file_path"]


def _current(spark, d):
    return T.units(spark, d).select("repo_id", "file_path", "hash")


def incremental_changed(spark, d):
    return R.changed_files(_current(spark, d), _stored(spark, d), _KEYS)


def incremental_skipped(spark, d):
    return R.unchanged_files(_current(spark, d), _stored(spark, d), _KEYS)


def tombstones(spark, d):
    return R.tombstones(_current(spark, d), _stored(spark, d), _KEYS)


def scan_counters(spark, d):
    return S.scan_counters(_current(spark, d), _stored(spark, d), _KEYS)


def hash_upsert(spark, d):
    return R.upsert(_stored(spark, d), _current(spark, d), _KEYS)


def _raw_edges(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("part#"), F.col("l_partkey").cast("string")).alias("caller"), F.concat(F.lit("supp#"), F.col("l_suppkey").cast("string")).alias("callee"), F.col("l_linenumber").alias("call_line"), F.col("l_orderkey").alias("ordinal"))


_RAW = "raw AS (SELECT concat('part#', CAST(l_partkey AS VARCHAR)) AS caller, concat('supp#', CAST(l_suppkey AS VARCHAR)) AS callee, l_linenumber AS call_line, l_orderkey AS ordinal FROM lineitem)"


def dedup_first(spark, d):
    return R.first_by(_raw_edges(spark, d), ["caller", "callee"], "ordinal", "call_line")


def dedup_last(spark, d):
    return R.last_by(_raw_edges(spark, d), ["caller", "callee"], "ordinal", "call_line")


def replace_by_file(spark, d):
    stored = T.units(spark, d).select("repo_id", "file_path", "qualified_name", "end_line")
    files = R.changed_files(_current(spark, d), _stored(spark, d), _KEYS).select(*_KEYS)
    fresh = stored.join(files, _KEYS, "left_semi").withColumn("end_line", F.col("end_line") + 1)
    return R.replace_by_file(stored, fresh, files, _KEYS)


def cascade_delete(spark, d):
    repos = T.table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("repo_id"))
    return R.cascade(T.units(spark, d).select("repo_id", "qualified_name"), repos, "repo_id")


def fingerprint_changed(spark, d):
    new = T.units(spark, d).select("unit_id", "qualified_name", "signature", "body_text")
    old = new.join(T.table(spark, d, "labels").withColumnRenamed("doc_id", "unit_id"), "unit_id")
    body = F.when(F.col("quality") == 0, F.concat("body_text", F.lit("x"))).when(F.col("toxic") == 0, F.replace("body_text", F.lit(" "), F.lit("\n  "))).otherwise(F.col("body_text"))
    return R.changed_units(new, old.withColumn("body_text", body), ["qualified_name"]).select("qualified_name", "fingerprint", "change")


FINGERPRINT_SQL = rf"""WITH {T.U}, f AS (SELECT qualified_name, signature, body_text, doc_id IS NULL AS fresh,
  CASE WHEN quality = 0 THEN concat(body_text, 'x') WHEN toxic = 0 THEN replace(body_text, ' ', concat(chr(10), '  ')) ELSE body_text END AS old_body FROM units LEFT JOIN labels ON doc_id = unit_id),
g AS (SELECT qualified_name, md5(trim(regexp_replace(concat(signature, body_text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS fingerprint,
  CASE WHEN NOT fresh THEN md5(trim(regexp_replace(concat(signature, old_body), '[ \t\n\x0B\f\r]+', ' ', 'g'))) END AS old FROM f)
SELECT qualified_name, fingerprint, CASE WHEN old IS NULL THEN 'new' ELSE 'modified' END AS change FROM g WHERE old IS NULL OR old <> fingerprint"""


def point_id(spark, d):
    return T.units(spark, d).select("unit_id", C.point_id(F.col("repo_id"), F.col("qualified_name")).alias("point_id"))


def method_autocomplete(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), F.col("p_partkey").cast("string")).alias("qualified_name"))
    return retrieval.autocomplete(p, " BRAND#1_.1 ", 80).union(retrieval.autocomplete(p, "  "))


def units_by_file(spark, d):
    b = T.blocks(spark, d)
    return b.groupBy("file_path").agg(F.count("*").alias("units"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def embed_text(spark, d):
    u = T.units(spark, d).withColumn("sig", F.when(F.col("unit_id") % 3 == 0, "").otherwise(F.col("signature")))
    comment, params = F.when(F.col("unit_id") % 4 == 0, "").otherwise(F.col("body_text")), F.array(F.col("language"), F.lit("x"))
    return u.select("unit_id", C.signature_text(F.col("sig"), F.col("name")).alias("signature_text"), C.context_text(F.col("sig"), F.col("name"), comment, params, F.col("body_text")).alias("context_text"))


EMBED_SQL = f"""WITH {T.U} SELECT unit_id, coalesce(nullif(CASE WHEN unit_id % 3 = 0 THEN '' ELSE signature END, ''), name) AS signature_text,
  trim(concat_ws(' ', nullif(coalesce(nullif(CASE WHEN unit_id % 3 = 0 THEN '' ELSE signature END, ''), name), ''), nullif(substr(CASE WHEN unit_id % 4 = 0 THEN '' ELSE body_text END, 1, 200), ''),
    concat(language, ' x'), nullif(substr(body_text, 1, 300), ''))) AS context_text FROM units"""


def camel_summary(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.concat(F.lit("get"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("name"))
    return p.select("p_partkey", "name", C.camel_words(F.col("name")).alias("words"), F.concat_ws(" | ", F.concat(F.lit("[Java] method "), C.camel_words(F.col("name"))), F.when(F.col("name").startswith("get"), F.concat(F.lit("getter for "), F.substring("name", 4, 1000)))).alias("summary"))


CAMEL_SQL = r"""WITH p AS (SELECT p_partkey, concat('get', list_aggregate(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), 'string_agg', '')) AS name FROM part)
SELECT p_partkey, name, trim(regexp_replace(name, '([A-Z])', ' \1', 'g')) AS words, concat_ws(' | ', concat('[Java] method ', trim(regexp_replace(name, '([A-Z])', ' \1', 'g'))), concat('getter for ', substr(name, 4))) AS summary FROM p"""


def slices(spark, d):
    u = T.units(spark, d).select("unit_id", F.split("body_text", " ").alias("calls"))
    return u.select("unit_id", F.slice("calls", 1, 5).alias("_c")).select("unit_id", F.array_join("_c", ", ").alias("first_calls"), F.size("_c").cast("bigint").alias("n"))


SLICES_SQL = f"WITH {T.U} SELECT unit_id, array_to_string(string_split(body_text, ' ')[1:5], ', ') AS first_calls, CAST(len(string_split(body_text, ' ')[1:5]) AS BIGINT) AS n FROM units"

QUERIES = {
    "q_unit_stats": (unit_stats, f"WITH {T.U} SELECT repo_id, count(*) AS units, " + ", ".join(f"count(DISTINCT file_path) FILTER (language = '{x}') AS {x}_files" for x in LANGS) + " FROM units GROUP BY repo_id"),
    "q_units_since": (units_since, f"WITH {T.EV} SELECT kind, count(*) AS units, count(DISTINCT path) AS files FROM ev WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY kind"),
    "q_embeddable_counts": (embeddable_counts, f"WITH {T.U}, l AS (SELECT repo_id, len(list_filter(string_split(body_text, chr(10)), lambda x: trim(x) <> '')) AS n FROM units) SELECT repo_id, count(*) FILTER (n > 1) AS embeddable, count(*) FILTER (n <= 1) AS filtered FROM l GROUP BY repo_id"),
    "q_skip_dirs_third_party": (scan_filter, SCAN_SQL),
    "q_watch_path_filter": (watch_path_filter, WATCH_SQL),
    "q_incremental_changed": (incremental_changed, f"WITH {_STORED} SELECT repo_id, file_path, hash FROM units u WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.repo_id = u.repo_id AND s.file_path = u.file_path AND s.hash = u.hash)"),
    "q_incremental_skipped": (incremental_skipped, f"WITH {_STORED} SELECT repo_id, file_path, hash FROM units u WHERE EXISTS (SELECT 1 FROM stored s WHERE s.repo_id = u.repo_id AND s.file_path = u.file_path AND s.hash = u.hash)"),
    "q_tombstones": (tombstones, f"WITH {_STORED} SELECT repo_id, file_path, hash FROM stored s WHERE NOT EXISTS (SELECT 1 FROM units u WHERE s.repo_id = u.repo_id AND s.file_path = u.file_path)"),
    "q_scan_counters": (scan_counters, f"WITH {_STORED} SELECT count(*) FILTER (s.hash IS NULL OR s.hash <> u.hash) AS updated, count(*) FILTER (s.hash = u.hash) AS skipped, count(*) AS total FROM units u LEFT JOIN stored s ON s.repo_id = u.repo_id AND s.file_path = u.file_path"),
    "q_hash_upsert": (hash_upsert, f"WITH {_STORED} SELECT repo_id, file_path, hash FROM stored s WHERE NOT EXISTS (SELECT 1 FROM units u WHERE s.repo_id = u.repo_id AND s.file_path = u.file_path) UNION ALL SELECT repo_id, file_path, hash FROM units"),
    "q_dedup_first": (dedup_first, f"WITH {_RAW} SELECT caller, callee, call_line, ordinal FROM raw QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY ordinal, call_line) = 1"),
    "q_dedup_last": (dedup_last, f"WITH {_RAW} SELECT caller, callee, call_line, ordinal FROM raw QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY ordinal DESC, call_line DESC) = 1"),
    "q_replace_by_file": (replace_by_file, f"WITH {_STORED}, files AS (SELECT u.repo_id, u.file_path FROM units u WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.repo_id = u.repo_id AND s.file_path = u.file_path AND s.hash = u.hash)) SELECT repo_id, file_path, qualified_name, CAST(end_line + CASE WHEN (repo_id, file_path) IN (SELECT (repo_id, file_path) FROM files) THEN 1 ELSE 0 END AS INT) AS end_line FROM units"),
    "q_cascade_delete": (cascade_delete, f"WITH {T.U} SELECT repo_id, qualified_name FROM units WHERE repo_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)"),
    "q_fingerprint_changed": (fingerprint_changed, FINGERPRINT_SQL),
    "q_point_id": (point_id, f"WITH {T.U} SELECT unit_id, md5(concat_ws('::', CAST(repo_id AS VARCHAR), qualified_name)) AS point_id FROM units"),
    "q_method_autocomplete": (method_autocomplete, "SELECT p_partkey, p_name AS name, concat(p_brand, '.', CAST(p_partkey AS VARCHAR)) AS qualified_name FROM part WHERE lower(p_name) LIKE '%brand#1_.1%' OR lower(concat(p_brand, '.', CAST(p_partkey AS VARCHAR))) LIKE '%brand#1_.1%' ORDER BY name, qualified_name LIMIT 50"),
    "q_units_by_file": (units_by_file, f"WITH {T.UB} SELECT file_path, count(*) AS units, min(start_line) AS first_line, max(end_line) AS last_line FROM blocks GROUP BY file_path"),
    "q_embed_text": (embed_text, EMBED_SQL),
    "q_camel_summary": (camel_summary, CAMEL_SQL),
    "q_slices": (slices, SLICES_SQL),
}
