"""Hybrid retrieval: top-k by collection, reciprocal-rank fusion, keyword supplement, merge, re-rank.

All operators work on batches of queries: a ``query_id`` column goes through, so one
job answers any number of them.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, TERMS, Settings
from ..functions.columns import LOWER, UPPER, ascii_fold, contains_like, inner_product, trivial_name
from . import blocks, substring

#: Queries broadcast at once (some megabytes of vectors), and pairs of query and word that one scan looks for.
QUERY_BATCH, WORD_BATCH = 512, 256


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, language: Column | None = None) -> DataFrame:
    """``query_id, collection, id, score, rank``: best ``k`` of each collection for each query.

    ``vectors``: ``collection, id, vector``; ``queries``: ``query_id, collection, query``.
    Up to ``QUERY_BATCH`` queries are broadcast, so the vectors are never shuffled; more meet
    blocks of vectors (:mod:`.blocks`), each only those that can hold one of its best. The rank's limit is
    applied before the shuffle of scores.
    """
    kept = vectors if language is None else vectors.where(language)
    if queries.limit(QUERY_BATCH + 1).count() > QUERY_BATCH:
        hits, _ = blocks.topk(blocks.build(kept), queries, k)
        return hits.select("query_id", "collection", "id", "score", "rank")
    w = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id")
    scored = kept.join(F.broadcast(queries), "collection").select("query_id", "collection", "id", F.round(inner_product(F.col("vector"), F.col("query")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(hits: DataFrame, n: int, settings: Settings = DEFAULT) -> DataFrame:
    """``query_id, id, rrf_score, place``: sum over collections of 1 / (K + rank), best ``n``."""
    summed = hits.groupBy("query_id", "id").agg(F.sum(1.0 / (settings.rrf_k + F.col("rank"))).alias("rrf"))
    return _best(summed, n)


def fuse_outer(left: DataFrame, right: DataFrame, n: int, settings: Settings = DEFAULT) -> DataFrame:
    """:func:`fuse` of two collections as a full outer join."""
    term = lambda c: F.coalesce(1.0 / (settings.rrf_k + F.col(c)), F.lit(0.0))
    a, b = left.select("query_id", "id", F.col("rank").alias("ra")), right.select("query_id", "id", F.col("rank").alias("rb"))
    return _best(a.join(b, ["query_id", "id"], "full").select("query_id", "id", (term("ra") + term("rb")).alias("rrf")), n)


def _best(summed: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "id")
    ranked = summed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.select("query_id", "id", F.round("rrf", 6).alias("rrf_score"), "place")


def overlay(hits: DataFrame, units: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Hits with the unit's columns in place of their own where the unit is known."""
    detail = units.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = hits.join(detail, key, "left")
    rest = [c for c in hits.columns if c not in columns]
    return joined.select(*rest, *[(F.coalesce(F.col(f"_{c}"), F.col(c)) if c in hits.columns else F.col(f"_{c}")).alias(c) for c in columns])


def term_table(spark: SparkSession, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """``term, words``: the dictionary, a table of fixed size."""
    return spark.createDataFrame(list((terms or TERMS).items()), "term string, words array<string>")


def keywords(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, word``: words of three or more letters, and those of each dictionary term in the query.

    ``terms`` is the dictionary of about fifty rows, so it is the broadcast side of the
    one join here that has no key.
    """
    own = queries.select("query_id", F.explode(F.regexp_extract_all("query", F.lit("[a-zA-Z]{3,}"), F.lit(0))).alias("word"))
    found = queries.join(F.broadcast(terms), F.contains(F.col("query"), F.col("term"))).select("query_id", F.explode("words").alias("word"))
    return own.union(found).distinct()


def keyword_hits(units: DataFrame, words: DataFrame, limit: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Units whose name or summary contains a word of the query, and ``query_id``; first ``limit`` by name (F8, T5).

    ``words``: ``query_id, word``. Up to ``WORD_BATCH`` pairs become expressions of one scan: texts
    are folded once, and no join takes place. More are looked up by
    :func:`.substring.first_by_query`, and never reach the driver. A unit meets a query once.
    """
    n = settings.keyword_limit if limit is None else limit
    w = Window.partitionBy("query_id").orderBy("qualified_name")
    typed = words.select("query_id", "word").where("query_id is not null and word is not null").distinct().limit(WORD_BATCH + 1).collect()
    if len(typed) > WORD_BATCH:
        found = substring.first_by_query(units, words, ["qualified_name", "summary"], ["qualified_name"], n)
        return found.select(*[F.col(f"`{c}`") for c in units.columns], "query_id")
    kind = dict(words.dtypes)["query_id"]
    columns = [F.col(f"`{c}`") for c in units.columns]
    folded = units.select(F.struct(*columns).alias("_unit"), ascii_fold(F.col("qualified_name")).alias("_name"), ascii_fold(F.coalesce("summary", F.lit(""))).alias("_text"))
    asking: dict[str, list] = {}
    for query, word in sorted((r.query_id, r.word) for r in typed):
        asking.setdefault(word, []).append(query)
    found = [F.when(substring.contains_word(["_name", "_text"], word.translate(str.maketrans(UPPER, LOWER))), F.array(*map(F.lit, queries)).cast(f"array<{kind}>")) for word, queries in asking.items()]
    every = F.array_distinct(F.flatten(F.array_compact(F.array(*found)))) if found else F.array().cast(f"array<{kind}>")
    hits = folded.select("_unit", F.explode(every).alias("query_id")).select("_unit.*", "query_id")
    return hits.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def autocomplete(units: DataFrame, typed: str, limit: int = 20) -> DataFrame:
    """Units whose name or qualified name contains what was typed, by name; at most 50, none for a blank text."""
    if not typed.strip():
        return units.limit(0)
    text = F.lit(typed.strip())
    found = units.where(contains_like(F.col("name"), text) | contains_like(F.col("qualified_name"), text))
    return found.orderBy("name", "qualified_name").limit(max(1, min(limit, 50)))


def collection_counts(vectors: DataFrame, collections: DataFrame) -> DataFrame:
    """``collection, n`` for each collection asked for; one that isn't there has 0 (SC15, A12)."""
    counted = vectors.groupBy("collection").agg(F.count("*").alias("n"))
    return collections.select("collection").distinct().join(counted, "collection", "left").select("collection", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def count_or_error(read: Callable[[], DataFrame]) -> int:
    """Number of rows of a table; -1 if it can't be read (SC15)."""
    try:
        return read().count()
    except PySparkException:
        return -1


def merge_hits(vector_hits: DataFrame, keyword_hits_: DataFrame) -> DataFrame:
    """``query_id, qualified_name, name, score, source, place``: both kinds merged.

    Trivial names of vector hits count 0.05 times their score; a hit of both kinds gets
    0.3 at least; a hit by keyword alone 0.01, or 0.001 with a trivial name.
    """
    v = vector_hits.select("query_id", "qualified_name", F.col("name").alias("v_name"), "rrf_score")
    k = keyword_hits_.select("query_id", "qualified_name", F.col("name").alias("k_name"))
    joined = v.join(k, ["query_id", "qualified_name"], "full")
    own = F.when(trivial_name(F.col("v_name")), F.col("rrf_score") * 0.05).otherwise(F.col("rrf_score"))
    score = (
        F.when(F.col("rrf_score").isNull(), F.when(trivial_name(F.col("k_name")), 0.001).otherwise(0.01))
        .when(F.col("k_name").isNotNull(), F.greatest(own, F.lit(0.3)))
        .otherwise(own)
    )
    source = F.when(F.col("rrf_score").isNull(), "keyword").otherwise("vector")
    out = joined.select("query_id", "qualified_name", F.coalesce("v_name", "k_name").alias("name"), F.round(score, 9).alias("score"), source.alias("source"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("source"), "qualified_name")
    return out.withColumn("place", F.row_number().over(w))


def rerank(hits: DataFrame, top: int) -> DataFrame:
    """Best ``top`` of each query by ``rerank_score`` rounded first; ties stay as they were (``place``) (T4)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")
    scored = hits.withColumn("rerank_score", F.round("rerank_score", 6))
    return scored.withColumn("final_place", F.row_number().over(w)).where(F.col("final_place") <= top)

