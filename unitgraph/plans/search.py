"""Hybrid search for a batch of queries (entry B of the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import inner_product, rerank_text
from ..operators import retrieval as R
from ..operators.rows import first_by
from .embedding import Embedder, embed


def search(queries: DataFrame, units: DataFrame, vectors: DataFrame, embedder: Embedder, settings: Settings = DEFAULT, translate=None) -> DataFrame:
    """Best ``rerank_top`` units of each of ``query_id, query``.

    ``translate``: a Column function for the text that is embedded (Q22; the identity by
    default); keywords and the re-ranking use the query as typed.
    """
    searched = F.col("query") if translate is None else translate(F.col("query"))
    encoded = queries.select("query_id", F.explode(F.array(F.lit("signatures"), F.lit("context"))).alias("collection"), embed(searched, embedder).alias("query"))
    one = first_by(units, ["qualified_name"], "file_path", "start_line")
    hits = R.fuse(R.vector_topk(vectors, encoded, settings.fetch), settings.candidates, settings)
    names = vectors.select("id", "qualified_name").distinct()
    known = one.select("qualified_name", "name")
    fused = hits.join(names, "id").join(known, "qualified_name")
    words = R.keywords(queries, R.term_table(queries.sparkSession))
    merged = R.merge_hits(fused, R.keyword_hits(one, words, settings=settings))
    detailed = merged.drop("name").join(one, "qualified_name")
    texts = rerank_text(F.col("signature"), F.col("qualified_name"), F.col("summary"), F.col("body_text"))
    own = queries.select("query_id", embed(F.col("query"), embedder).alias("_q"))
    scored = detailed.join(own, "query_id").withColumn("rerank_score", inner_product(embed(texts, embedder), F.col("_q"))).drop("_q")
    return R.rerank(scored, settings.rerank_top)
