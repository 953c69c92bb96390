"""Helpers that several operators of this subpackage share.

Intermediate results that are read more than once, or that end a long lineage,
are written as Parquet below the folder named by ``spark.checkpoint.dir`` and
read again, so a lost executor costs a re-read and never a whole recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = qualified(spark, spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="unitgraph-"))
        _ROOTS[app] = f"{base.rstrip('/')}/unitgraph-{app}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of its file system, as all readers understand it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its URI names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at interpreter exit
        pass


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` to a new shared table and return its path.

    The shuffle files of the job that made it are released once it is written:
    the table replaces them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        # a setting that isn't set reads as None
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back (cuts lineage, computed once)."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def new_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    free = (name for k in range(len(taken) + n) if (name := f"own_{k}") not in taken)
    return [next(free) for _ in range(n)]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that Spark can hash."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has bigint columns ``a`` and ``b``, in any direction, repeats and
    loops allowed. Returns ``node, root`` for every node of an edge that is not
    a loop; ``root`` is the smallest node reachable (roots are rows too). Each
    round is two aggregations (combined before the shuffle, so a hub costs one
    row per task) and two equi-joins that adaptive execution may split.
    """
    spark = edges.sparkSession
    current = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    path = write_table(current, "edges")
    schema = "u bigint, v bigint"
    state = None
    for _ in range(max_rounds):
        e = spark.read.schema(schema).parquet(path)
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = tuple(seen)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = (
            e.join(least, e.u == least.k).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        )
        low = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        small = (
            large.join(low, large.v == low.k)
            .select(F.least("u", "m").alias("p"), F.greatest("u", "m").alias("q"), "m", "v")
            .select(F.explode(F.array(F.struct(F.col("p").alias("u"), F.col("q").alias("v")), F.struct(F.col("m").alias("u"), F.col("v")))).alias("e"))
            .select("e.u", "e.v").where("u < v").distinct()
        )
        fresh = write_table(small, "edges")
        drop_path(spark, path)
        path = fresh
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = spark.read.schema(schema).parquet(path)
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
