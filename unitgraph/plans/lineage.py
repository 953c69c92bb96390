"""Results that later steps read several times, kept in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a name list up to which it is broadcast: some megabytes.
SMALL = 100_000
#: Bits of the bitmap that stands for a longer list: 2**18 numbers at most, whatever the list's length.
BITS = 1 << 24
_ROOTS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="unitgraph-")
        _ROOTS[app] = f"{base.rstrip('/')}/unitgraph-core-{app}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at interpreter exit
        pass


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below this application's, gone when the application ends."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed now and written as a table: a lost executor costs a re-read, and its size is known to the optimizer."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_named(table: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``column`` is one of ``names`` (a column of that name, different values).

    Up to ``SMALL`` names are broadcast, and the optimizer takes the filter below the
    table's aggregations; more are joined by key, behind the same kind of filter by a bitmap.
    """
    own = names.select(column)
    if own.count() <= SMALL:
        return table.join(F.broadcast(own), column, "left_semi")
    return maybe_named(table, column, own).join(own, column, "left_semi")


def maybe_named(table: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``table`` without most of the rows whose ``column`` isn't one of ``names``, however many: a bitmap of ``BITS`` bits is broadcast."""
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    bitmap = names.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return table.join(F.broadcast(bitmap), (F.shiftright(place, 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0), "left_semi")


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table of few bytes and much work a row, dealt over all cores by ``key``: file splits are made by bytes."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, key)
