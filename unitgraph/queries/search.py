"""Queries of hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks as B
from ..operators import render, rows, substring
from ..operators import retrieval as R
from ..plans import tables as T
from ..plans.lineage import spread

_N = 20


def _queries(spark, d):
    """A batch of query vectors: the first vector of each label, in both collections."""
    v = T.vectors(spark, d)
    first = rows.first_by(v, ["collection", "label"], "id")
    return first.select(F.col("label").cast("bigint").alias("query_id"), "collection", F.col("vector").alias("query"))


_SCORED = f"""{T.V}, queries AS (SELECT CAST(label AS BIGINT) AS query_id, collection, vector AS query FROM vectors QUALIFY row_number() OVER (PARTITION BY collection, label ORDER BY id) = 1),
scored AS (SELECT q.query_id, v.collection, v.id, v.label, round(list_inner_product(v.vector, q.query), 6) AS score FROM vectors v JOIN queries q ON q.collection = v.collection),
top AS (SELECT query_id, collection, id, score, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 60),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM top GROUP BY query_id, id),
best AS (SELECT query_id, id, round(rrf, 6) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS place FROM fused QUALIFY place <= 20)"""


def vector_topk(spark, d):
    hits = R.vector_topk(T.vectors(spark, d), _queries(spark, d), 60, F.col("label") >= 2)
    return hits.select("query_id", "collection", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def vector_blocks(spark, d):
    """The same hits from blocks of vectors, with a payload filter."""
    hits, _ = B.topk(B.build(T.vectors(spark, d), 64, "label"), _queries(spark, d), 60, low=2)
    return hits.select("query_id", "collection", "id", "score", F.col("rank").cast("bigint").alias("rank"))


TOPK_SQL = f"WITH {_SCORED} SELECT query_id, collection, id, score, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS rank FROM scored WHERE label >= 2 QUALIFY rank <= 60"


def _hits(spark, d):
    return R.vector_topk(T.vectors(spark, d), _queries(spark, d), 60)


def rrf_fusion(spark, d):
    return R.fuse(_hits(spark, d), _N).withColumn("place", F.col("place").cast("bigint"))


def rrf_outer(spark, d):
    hits = _hits(spark, d)
    sig, ctx = hits.where("collection = 'signatures'"), hits.where("collection = 'context'")
    return R.fuse_outer(sig, ctx, _N).withColumn("place", F.col("place").cast("bigint"))


FUSED_SQL = f"WITH {_SCORED} SELECT query_id, id, rrf_score, place FROM best"


def _texts(spark, d):
    """Queries in words: the benchmark's items."""
    return T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword_terms(spark, d):
    inline = spark.createDataFrame([(-1, "查询用户 isEmpty"), (-2, "リスト の 空チェック"), (-3, "日志 %_ log")], "query_id bigint, query string")
    return R.keywords(_texts(spark, d).union(inline), R.term_table(spark))


def _terms_sql():
    values = ", ".join("('{}', [{}])".format(t, ", ".join(f"'{w}'" for w in ws)) for t, ws in R.TERMS.items())
    return f"""terms(term, words) AS (VALUES {values}), texts AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL VALUES (-1, '查询用户 isEmpty'), (-2, 'リスト の 空チェック'), (-3, '日志 %_ log')),
    words AS (SELECT query_id, unnest(regexp_extract_all(query, '[a-zA-Z]{{3,}}')) AS word FROM texts UNION SELECT query_id, unnest(words) FROM texts JOIN terms ON contains(query, term))"""


def _words(spark, d):
    """Two words of each label as typed queries."""
    return spark.createDataFrame([(0, "EN#DOC1"), (0, "Widget"), (1, "is_"), (1, "Églé"), (2, "the anin"), (3, "de#"), (3, "100%")], "query_id bigint, word string")


_WORDS = "words(query_id, word) AS (VALUES (CAST(0 AS BIGINT), 'EN#DOC1'), (0, 'Widget'), (1, 'is_'), (1, 'Églé'), (2, 'the anin'), (3, 'de#'), (3, '100%'))"


def _summaries(spark, d):
    return T.units(spark, d).withColumn("summary", F.col("body_text"))


def keyword_search(spark, d):
    return R.keyword_hits(_summaries(spark, d), _words(spark, d)).select("query_id", "qualified_name", "file_path")


def keyword_batch(spark, d):
    """Every benchmark text as a query: thousands of words, looked up among the different words of the texts."""
    typed = T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    words = typed.select("query_id", F.explode(F.regexp_extract_all("query", F.lit("[a-zA-Z]{3,}"), F.lit(0))).alias("word")).distinct()
    return R.keyword_hits(_summaries(spark, d), words).select("query_id", "qualified_name", "file_path")


def autocomplete_batch(spark, d):
    """The first letters of customers' and parts' names, typed at once, against the names of suppliers and parts."""
    parts = spread(T.table(spark, d, "part"), "p_partkey")
    part = parts.select(F.col("p_name").alias("name"), F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("qualified_name"))
    supplier = T.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string")).alias("qualified_name"))
    key = F.col("p_partkey")
    typed = T.table(spark, d, "part").select(key.alias("query_id"), F.when(key % 9 == 0, F.lit(" ")).when(key % 9 == 1, F.concat(F.lit("T_"), (key % 10).cast("string"))).otherwise(F.concat(F.lit(" "), F.upper(F.substring("p_name", 3, 7)), F.lit(" "))).alias("typed"))
    return substring.first_hits(part.union(supplier), typed, 3).select("query_id", "place", "name", "qualified_name")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MATCH = f"({_FOLD.format('qualified_name')} LIKE concat('%', {_FOLD.format('word')}, '%') OR {_FOLD.format('body_text')} LIKE concat('%', {_FOLD.format('word')}, '%'))"
_KEYWORD = f"""{_WORDS}, matched AS (SELECT DISTINCT query_id, qualified_name, name, file_path FROM units JOIN words ON {_MATCH}),
kw AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY qualified_name) <= 15)"""


KEYWORD_BATCH = f"""WITH {T.U}, words AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[a-zA-Z]{{3,}}')) AS word FROM benchmark),
folded AS (SELECT qualified_name, file_path, {_FOLD.format("qualified_name")} AS a, {_FOLD.format("body_text")} AS b FROM units),
own AS (SELECT DISTINCT {_FOLD.format("word")} AS w FROM words), found AS (SELECT w, qualified_name, file_path FROM folded JOIN own ON contains(a, w) OR contains(b, w)),
matched AS (SELECT DISTINCT query_id, qualified_name, file_path FROM words JOIN found ON w = {_FOLD.format("word")})
SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY qualified_name) <= 15"""

AUTOCOMPLETE_BATCH = f"""WITH n AS (SELECT p_name AS name, concat('part.', CAST(p_partkey AS VARCHAR)) AS qualified_name FROM part UNION ALL SELECT s_name, concat('supplier.', CAST(s_suppkey AS VARCHAR)) FROM supplier),
q AS (SELECT p_partkey AS query_id, CASE p_partkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN concat('T_', CAST(p_partkey % 10 AS VARCHAR)) ELSE upper(substr(p_name, 3, 7)) END AS typed FROM part),
t AS (SELECT query_id, {_FOLD.format("trim(typed)")} AS w FROM q WHERE trim(typed) <> ''), own AS (SELECT DISTINCT w FROM t),
found AS (SELECT DISTINCT w, name, qualified_name FROM n JOIN own ON {_FOLD.format("name")} LIKE concat('%', w, '%') OR {_FOLD.format("qualified_name")} LIKE concat('%', w, '%')),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY name, qualified_name) AS place, name, qualified_name FROM t JOIN found USING (w))
SELECT * FROM ranked WHERE place <= 3"""


def _vector_hits(spark, d):
    """Fused hits as units: vector i stands for document i."""
    u = T.units(spark, d).select(F.col("unit_id").alias("id"), "qualified_name", F.when(F.col("unit_id") % 3 == 0, F.concat(F.lit("get"), "name")).otherwise(F.col("name")).alias("name"))
    return R.fuse(_hits(spark, d), _N).join(u, "id")


def hybrid_merge(spark, d):
    v, k = _vector_hits(spark, d), R.keyword_hits(_summaries(spark, d), _words(spark, d))
    own = v.select("query_id", F.col("qualified_name"), "name", "rrf_score")
    # hits of some queries come by keyword as well
    also = own.where("query_id >= 5 and name not like 'get%'").select("query_id", "qualified_name", "name")
    kw = k.select("query_id", "qualified_name", "name").union(also)
    return R.merge_hits(own, kw).withColumn("place", F.col("place").cast("bigint"))


HYBRID_SQL = f"""WITH {_SCORED}, {T.U}, {_KEYWORD}, vh AS (SELECT b.query_id, u.qualified_name, CASE WHEN unit_id % 3 = 0 THEN concat('get', name) ELSE name END AS name, rrf_score FROM best b JOIN units u ON u.unit_id = b.id),
kws AS (SELECT query_id, qualified_name, name FROM kw UNION ALL SELECT query_id, qualified_name, name FROM vh WHERE query_id >= 5 AND name NOT LIKE 'get%'),
j AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.qualified_name, k.qualified_name) AS qualified_name, coalesce(v.name, k.name) AS name, v.rrf_score AS s, k.name AS kn,
  CASE WHEN (v.name LIKE 'get%' OR v.name LIKE 'set%') AND length(v.name) > 3 THEN v.rrf_score * 0.05::DOUBLE ELSE v.rrf_score END AS own FROM vh v FULL JOIN kws k ON k.query_id = v.query_id AND k.qualified_name = v.qualified_name),
m AS (SELECT query_id, qualified_name, name, round(CASE WHEN s IS NULL THEN CASE WHEN (kn LIKE 'get%' OR kn LIKE 'set%') AND length(kn) > 3 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END WHEN kn IS NOT NULL THEN greatest(own, 0.3::DOUBLE) ELSE own END, 9) AS score,
  CASE WHEN s IS NULL THEN 'keyword' ELSE 'vector' END AS source FROM j)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source DESC, qualified_name) AS place FROM m"""


def rerank(spark, d):
    """Re-rank the fused hits by the product of their whole vectors, in front of the fused order."""
    v = T.vectors(spark, d).where("collection = 'signatures'").select("id", "vector")
    q = _queries(spark, d).where("collection = 'signatures'").select("query_id", "query")
    scored = R.fuse(_hits(spark, d), _N).join(v, "id").join(q, "query_id").withColumn("rerank_score", C.inner_product(F.col("vector"), F.col("query")))
    return R.rerank(scored, 5).select("query_id", "id", "rerank_score", F.col("final_place").cast("bigint").alias("final_place"))


RERANK_SQL = f"""WITH {_SCORED}, s AS (SELECT b.query_id, b.id, b.place, round(list_inner_product(v.vector, q.query), 6) AS rerank_score FROM best b JOIN vectors v ON v.id = b.id AND v.collection = 'signatures' JOIN queries q ON q.query_id = b.query_id AND q.collection = 'signatures')
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place) AS final_place FROM s QUALIFY final_place <= 5"""


def rerank_texts(spark, d):
    return T.units(spark, d).select("unit_id", F.md5(C.rerank_text(F.col("signature"), F.col("qualified_name"), F.lit(""), F.col("body_text"))).alias("text_md5"))


RERANK_TEXT_SQL = rf"WITH {T.U} SELECT unit_id, md5(regexp_replace(concat_ws(chr(10), coalesce(nullif(signature, ''), qualified_name), '', substr(body_text, 1, 1500)), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS text_md5 FROM units"


def search_context(spark, d):
    k = R.keyword_hits(_summaries(spark, d), _words(spark, d))
    from pyspark.sql import Window

    placed = k.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("qualified_name")))
    lang = F.element_at(F.array(*map(F.lit, ["en", "zh", "ja", "xx"])), (F.col("query_id") % 4 + 1).cast("int"))
    return render.search_context(placed, lang)


def formats_sql() -> str:
    """The formats as a SQL table, with %s as DuckDB's {}."""
    quote = lambda x: "'" + x.replace("'", "''").replace("%s", "{}") + "'"
    rows = ", ".join("(" + ", ".join(quote(x) for x in (lang, *own.values())) + ")" for lang, own in render.FORMATS.items())
    return f"formats(lang, {', '.join('f_' + k for k in render.KEYS)}) AS (VALUES {rows})"


CONTEXT_SQL = f"""WITH {T.U}, {_KEYWORD}, {formats_sql()}, p AS (SELECT kw.query_id, row_number() OVER (PARTITION BY kw.query_id ORDER BY kw.qualified_name) AS place, u.* FROM kw JOIN units u ON u.qualified_name = kw.qualified_name)
SELECT query_id, string_agg(format(f_hit, CAST(place AS VARCHAR), file_path, CAST(start_line AS VARCHAR), coalesce(nullif(signature, ''), qualified_name), substr(trim(body_text), 1, 600)), concat(chr(10), chr(10)) ORDER BY place) AS context
FROM p JOIN formats f ON f.lang = ['en', 'zh', 'ja', 'zh'][CAST(query_id % 4 + 1 AS INT)] GROUP BY query_id"""


def hit_union(spark, d):
    v, k = _vector_hits(spark, d), R.keyword_hits(_summaries(spark, d), _words(spark, d))
    both = v.select("query_id", "qualified_name", F.lit(0).alias("kind")).union(k.select("query_id", "qualified_name", F.lit(1)))
    return rows.first_by(both, ["query_id", "qualified_name"], "kind")


HIT_SQL = f"WITH {_SCORED}, {T.U}, {_KEYWORD}, b AS (SELECT b.query_id, u.qualified_name, 0 AS kind FROM best b JOIN units u ON u.unit_id = b.id UNION ALL SELECT query_id, qualified_name, 1 FROM kw) SELECT query_id, qualified_name, min(kind) AS kind FROM b GROUP BY 1, 2"


def detail_overlay(spark, d):
    hits = _vector_hits(spark, d).select("query_id", "qualified_name", F.lit("").alias("file_path"), F.lit("?").alias("signature"))
    known = T.units(spark, d).join(T.table(spark, d, "labels").select(F.col("doc_id").alias("unit_id")), "unit_id", "left_semi")
    return R.overlay(hits, known, "qualified_name", ["file_path", "signature"])


OVERLAY_SQL = f"WITH {_SCORED}, {T.U} SELECT b.query_id, u.qualified_name, CASE WHEN unit_id IN (SELECT doc_id FROM labels) THEN file_path ELSE '' END AS file_path, CASE WHEN unit_id IN (SELECT doc_id FROM labels) THEN signature ELSE '?' END AS signature FROM best b JOIN units u ON u.unit_id = b.id"


def collection_counts(spark, d):
    asked = spark.createDataFrame([("signatures",), ("context",), ("nothing",)], "collection string")
    return R.collection_counts(T.vectors(spark, d), asked)


def vector_count(spark, d):
    return T.vectors(spark, d).groupBy("collection", "label").agg(F.count("*").alias("n"))


def vector_delete(spark, d):
    gone = T.table(spark, d, "region").select(F.col("r_regionkey").alias("label"))
    return rows.delete_vectors(T.vectors(spark, d), gone, ["label"]).select("collection", "id")


def detect_lang(spark, d):
    inline = spark.createDataFrame([(-1, "how to check a list"), (-2, "如何判断为空"), (-3, "リストが空"), (-4, "空チェック"), (-5, "")], "query_id bigint, query string")
    return _texts(spark, d).union(inline).select("query_id", C.language_of_query(F.col("query")).alias("lang"))


LANG_SQL = "WITH t AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL VALUES (-1, 'how to check a list'), (-2, '如何判断为空'), (-3, 'リストが空'), (-4, '空チェック'), (-5, '')) SELECT query_id, CASE WHEN regexp_matches(query, '[぀-ヿㇰ-ㇿ]') THEN 'ja' WHEN regexp_matches(query, '[一-鿿]') THEN 'zh' ELSE 'en' END AS lang FROM t"

QUERIES = {
    "q_vector_topk": (vector_topk, TOPK_SQL),
    "q_vector_blocks": (vector_blocks, TOPK_SQL),
    "q_rrf_fusion": (rrf_fusion, FUSED_SQL),
    "q_rrf_outer": (rrf_outer, FUSED_SQL),
    "q_keyword_terms": (keyword_terms, f"WITH {_terms_sql()} SELECT query_id, word FROM words"),
    "q_keyword_search": (keyword_search, f"WITH {T.U}, {_KEYWORD} SELECT query_id, qualified_name, file_path FROM kw"),
    "q_keyword_batch": (keyword_batch, KEYWORD_BATCH),
    "q_autocomplete_batch": (autocomplete_batch, AUTOCOMPLETE_BATCH),
    "q_hybrid_merge": (hybrid_merge, HYBRID_SQL),
    "q_rerank": (rerank, RERANK_SQL),
    "q_rerank_texts": (rerank_texts, RERANK_TEXT_SQL),
    "q_search_context": (search_context, CONTEXT_SQL),
    "q_hit_union": (hit_union, HIT_SQL),
    "q_detail_overlay": (detail_overlay, OVERLAY_SQL),
    "q_vector_count": (vector_count, f"WITH {T.V} SELECT collection, label, count(*) AS n FROM vectors GROUP BY 1, 2"),
    "q_collection_counts": (collection_counts, f"WITH {T.V} SELECT c AS collection, (SELECT count(*) FROM vectors WHERE collection = c) AS n FROM (VALUES ('signatures'), ('context'), ('nothing')) t(c)"),
    "q_vector_delete": (vector_delete, f"WITH {T.V} SELECT collection, id FROM vectors WHERE label NOT IN (SELECT r_regionkey FROM region)"),
    "q_detect_lang": (detect_lang, LANG_SQL),
}
