"""Integrity rules and incremental maintenance of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fingerprint


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; ``order`` must be total (insert-or-ignore)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key (insert-or-replace)."""
    return first_by(df, keys, *[F.desc(c) for c in order])


def changed_files(current: DataFrame, stored: DataFrame, keys: list[str], hash_col: str = "hash") -> DataFrame:
    """Files that are new or whose hash differs."""
    return current.join(stored.select(*keys, hash_col), [*keys, hash_col], "left_anti")


def unchanged_files(current: DataFrame, stored: DataFrame, keys: list[str], hash_col: str = "hash") -> DataFrame:
    return current.join(stored.select(*keys, hash_col), [*keys, hash_col], "left_semi")


def tombstones(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored files that are gone (Q7)."""
    return stored.join(current.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` in place of those with the same key (K1)."""
    return stored.join(fresh.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def replace_by_file(stored: DataFrame, fresh: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the rows of ``files``, and ``fresh`` (K2; edges carry their file, Q39)."""
    return stored.join(files.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of parents that are still there."""
    return children.join(parents.select(key), key, "left_semi")


def changed_units(fresh: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Units that are new or whose fingerprint differs, with ``change`` (J11, ST4)."""
    old = stored.select(*keys, fingerprint(F.col("signature"), F.col("body_text")).alias("_old"))
    new = fresh.withColumn("fingerprint", fingerprint(F.col("signature"), F.col("body_text")))
    joined = new.join(old, keys, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("fingerprint")))
    return joined.withColumn("change", F.when(F.col("_old").isNull(), "new").otherwise("modified")).drop("_old")


def removed_units(fresh: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Units that are gone (Q34)."""
    return stored.join(fresh.select(*keys), keys, "left_anti")


def delete_vectors(vectors: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors outside the given files or repositories (K5)."""
    return vectors.join(files.select(*keys).distinct(), keys, "left_anti")


def numbered_names(df: DataFrame, keys: list[str], name: str, *order: str) -> DataFrame:
    """Repeated names get ``_1``, ``_2``, ... in order (W4, EX13, EX19)."""
    w = Window.partitionBy(*keys, name).orderBy(*order)
    n = F.row_number().over(w) - 1
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 0, F.concat_ws("_", F.col(name), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")
