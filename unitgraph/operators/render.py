"""Search hits and impact chains as text for a reader or a model, in three languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import falsy

#: Formats by language.
FORMATS = {
    "en": {
        "hit": "[%s] File: %s line %s\nSignature: %s\nCode:\n%s",
        "changed": "Changed method: %s\nLocation: %s line %s",
        "direct": "Direct callers (depth 1):",
        "direct_node": "  %s\n  Location: %s line %s%s",
        "direct_call": "  calls changed method at line %s",
        "indirect": "Indirect callers (depth 2+):",
        "indirect_node": "  [depth %s] %s\n  Location: %s line %s%s",
        "indirect_call": "  calls upstream at line %s",
    },
    "zh": {
        "hit": "[%s] 文件: %s 第%s行\n签名: %s\n代码:\n%s",
        "changed": "变更方法: %s\n位置: %s 第%s行",
        "direct": "直接调用（1层）：",
        "direct_node": "  %s\n  位置: %s 第%s行%s",
        "direct_call": "  在第 %s 行调用了变更方法",
        "indirect": "间接调用（2层以上）：",
        "indirect_node": "  [%s层] %s\n  位置: %s 第%s行%s",
        "indirect_call": "  在第 %s 行调用了上层方法",
    },
    "ja": {
        "hit": "[%s] ファイル: %s %s行目\nシグネチャ: %s\nコード:\n%s",
        "changed": "変更メソッド: %s\n場所: %s %s行目",
        "direct": "直接呼び出し（1層）：",
        "direct_node": "  %s\n  場所: %s %s行目%s",
        "direct_call": "  %s行目で変更メソッドを呼び出し",
        "indirect": "間接呼び出し（2層以上）：",
        "indirect_node": "  [%s層] %s\n  場所: %s %s行目%s",
        "indirect_call": "  %s行目で上位メソッドを呼び出し",
    },
}
KEYS = list(FORMATS["en"])


def format_table(spark: SparkSession) -> DataFrame:
    """``lang`` and a column for each format: three rows."""
    return spark.createDataFrame([(lang, *[own[k] for k in KEYS]) for lang, own in FORMATS.items()], "lang string, " + ", ".join(f"f_{k} string" for k in KEYS))


def _formats(df: DataFrame, lang: Column) -> DataFrame:
    """``df`` with the formats of its language, those of zh for an unknown one. The table has three rows: a bounded broadcast."""
    known = F.when(lang.isin(*FORMATS), lang).otherwise("zh")
    return df.withColumn("_lang", known).join(F.broadcast(format_table(df.sparkSession).withColumnRenamed("lang", "_lang")), "_lang").drop("_lang")


def _fill(template: str, *values: Column) -> Column:
    return F.call_function("format_string", F.col(f"f_{template}"), *[v.cast("string") for v in values])


def search_context(hits: DataFrame, lang: Column) -> DataFrame:
    """``query_id, context``: hits (by ``place``) as blocks of file, line, signature and 600 characters of code."""
    rows = _formats(hits, lang)
    code = F.substring(F.trim(F.coalesce("body_text", F.lit(""))), 1, 600)
    block = _fill("hit", F.col("place"), F.coalesce("file_path", F.lit("")), F.coalesce(F.col("start_line").cast("string"), F.lit("")), falsy(F.col("signature"), F.coalesce("qualified_name", F.lit(""))), code)
    listed = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"))


def impact_context(changed: DataFrame, nodes: DataFrame, lang: Column, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, context``: the changed unit, its direct callers, and the first of the others.

    ``changed``: ``start_qn, signature, file_path, start_line`` and what ``lang`` needs;
    ``nodes``: ``start_qn, qualified_name, depth, call_line`` and the same columns. A
    caller whose line isn't known (0) is listed without it.
    """
    heads = _formats(changed.withColumn("_l", lang), F.col("_l"))
    formats = heads.select("start_qn", *[f"f_{k}" for k in KEYS])
    # places are numbered within a start, so that one exchange serves the ranking, the join and the grouping
    every = Window.partitionBy("start_qn")
    numbered = nodes.withColumn("_direct", F.col("depth") == 1).withColumn("_place", F.row_number().over(every.orderBy(~F.col("_direct"), "depth", "qualified_name")))
    ranked = numbered.withColumn("_first", F.count_if("_direct").over(every)).where(F.col("_place") <= F.col("_first") + settings.indirect_limit)
    own = ranked.join(formats, "start_qn")
    empty = F.lit("")

    def called(which: str) -> Column:
        return F.when(F.col("call_line") > 0, _fill(f"{which}_call", F.col("call_line"))).otherwise(empty)

    direct = _fill("direct_node", F.col("signature"), F.col("file_path"), F.col("start_line"), called("direct"))
    indirect = _fill("indirect_node", F.col("depth"), F.col("signature"), F.col("file_path"), F.col("start_line"), called("indirect"))
    line = F.struct(F.when(F.col("_direct"), 2).otherwise(4).alias("part"), "_place", F.when(F.col("_direct"), direct).otherwise(indirect).alias("text"))
    heading = F.struct(F.when(F.col("_direct"), 1).otherwise(3).alias("part"), F.lit(0).alias("_place"), F.when(F.col("_direct"), F.col("f_direct")).otherwise(F.col("f_indirect")).alias("text"))
    # the first node of a kind brings its heading along, so that the nodes are made once; equal headings fall together below
    leads = (F.col("_place") == 1) | (F.col("_place") == F.col("_first") + 1)
    lines = own.select("start_qn", F.explode(F.when(leads, F.array(heading, line)).otherwise(F.array(line))).alias("l")).select("start_qn", "l.part", "l._place", "l.text")
    first = heads.select("start_qn", F.lit(0).alias("part"), F.lit(0).alias("_place"), _fill("changed", F.col("signature"), F.col("file_path"), F.col("start_line")).alias("text"))
    everything = first.union(lines)
    listed = F.array_sort(F.collect_set(F.struct("part", "_place", "text")))
    return everything.groupBy("start_qn").agg(F.concat(F.array_join(F.transform(listed, lambda x: x["text"]), "\n"), F.lit("\n")).alias("context"))
