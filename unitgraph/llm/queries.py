"""Driver queries of the language-model operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fim, html_extract, licenses, line_dedup, media, mixing, periodic, quality, simhash, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_diff=4)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), threshold=0.8)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), every=20, top=20)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_images(_table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_words=5, similarity=0.8)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"), unit="line", rate=100, spm=50, seed=7)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_period(_table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_warc": op2_warc,
        "op3_licenses": op3_licenses,
        "op4_ann": op4_ann,
        "op5_html": op5_html,
        "op6_mixing": op6_mixing,
        "op7_bpe": op7_bpe,
        "op8_media": op8_media,
        "op9_lines": op9_lines,
        "op10_quality": op10_quality,
        "op11_fim": op11_fim,
        "op12_runs": op12_runs,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fim": fim.SQL}
