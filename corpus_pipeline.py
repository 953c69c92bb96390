"""A corpus pipeline: quality, repeated lines, near-duplicates, source weights, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes
each result to the shared folder, reads it again as the next stage's input, and deletes it
once the stage behind it is written. All but the last return the columns of ``documents``.

For every stage: an empty table gives an empty table; rows are told apart by all their
columns, so null ids, repeated ids and columns that share a name with one of the
operators' own are rows and columns like others; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitgraph.llm import bpe, line_dedup, mixing, quality, simhash
from unitgraph.llm.queries import public_vocabulary
from unitgraph.llm.shared import drop_path, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on ``labels``) scores at least 0.7.

    Null and empty texts get the score of a text without features. Equal rows get equal
    scores, so all stay or all go. Without usable labels every score is the same.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; ``n_chars`` follows the text.

    Null texts stay null. Equal rows are one document and keep or lose the same lines; of
    lines that are alike, the one of the smallest id stays (null ids last, then row hash,
    then position). A document goes if lines were taken out and no word is left.
    """
    out = line_dedup.clean(docs, min_words=5, similarity=0.8)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Null and empty texts are near-duplicates of one another. Of equal rows one stays, of
    near copies with one id that of the smallest row hash. Rows with a null id stay.
    """
    return simhash.keep_one(docs, words=5, max_diff=6)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times.

    Null and empty texts, which have no words, come as often as the whole part of their
    source's rate says. A null source is a source.
    Equal rows share their copies. Ties are settled by hashes of id, row and seed.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens``, a row for each row; a null text has no ids. Other columns are left out."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", public_vocabulary("byte_bpe_50k.json"))
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", token_stage),
]

#: SQL can't express the stages (trained classifier, SimHash, prefix dynamic programming);
#: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, path = path, write_table(docs, f"stage{k}")
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:
                drop_path(spark, before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
