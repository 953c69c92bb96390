"""Source trees as DataFrames (SC1, SC2, F1-F3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import in_skipped_folder, language_of, slashes, third_party


def scan_tree(spark: SparkSession, root: str, repo_id: int, settings: Settings = DEFAULT, with_content: bool = True) -> DataFrame:
    """``repo_id, file_path, language, size, modified, hash`` (and ``content``) of the known source files below ``root``.

    Paths are relative to ``root``, so its own place doesn't matter (Q14). Folders, library
    names and sizes are decided on path and length alone, before any content is read. Files
    without a byte hold no units, and the file source passes over them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.substring_index(F.decode(F.encode(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "UTF-8"), "UTF-8"), f"{base}/", -1)
    found = files.select(F.lit(repo_id).cast("bigint").alias("repo_id"), slashes(path).alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    known = found.withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    kept = known.where(~in_skipped_folder(F.col("file_path")) & ~third_party(F.col("file_path"), F.col("language"), F.col("size"), settings))
    columns = ["repo_id", "file_path", "language", "size", "modified", F.md5("content").alias("hash")]
    return kept.select(*columns, *(["content"] if with_content else []))
