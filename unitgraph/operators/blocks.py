"""Exact top-k over vectors that lie in blocks, of which a search reads only those that can matter (T1, SC14, F14).

Vectors are put to the nearest of a bounded number of centres. A block's statistics are its
centre, the greatest distance from it, and the range of a payload column. No vector of a block scores
more than the centre's score plus the query's length times that distance, so blocks whose bound lies below the
k-th score found so far are never read, nor are blocks outside the payload filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inner_product
from ..plans.lineage import SMALL, cut

#: Scores are rounded to six digits, and bounds are computed in another order.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorBlocks:
    """``rows``: ``collection, block, id, vector`` and the payload; ``stats``: ``collection, block, n, centre, radius, low, high``, at most ``centres`` + 1 rows a collection."""

    rows: DataFrame
    stats: DataFrame
    payload: str | None


def build(vectors: DataFrame, centres: int = 64, payload: str | None = None, seed: int = 7) -> VectorBlocks:
    """Deal ``collection, id, vector`` rows to blocks around the ``centres`` vectors of each collection with the smallest hash.

    Vectors that hold nulls or other than finite numbers, or have another length than their
    collection's first centre, share a block of no bound (-1), which every search reads. Null vectors are left out.
    """
    kept = vectors.where(F.col("vector").isNotNull())
    by_hash = Window.partitionBy("collection").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("vector") > 0)
    chosen = kept.where(whole).select("collection", "id", F.col("vector").cast("array<double>").alias("vector")).withColumn("_place", F.row_number().over(by_hash)).where(F.col("_place") <= centres)
    books: dict[str, np.ndarray] = {}
    # a bounded number of rows of each collection; collections are few and named in the code that fills them
    for r in chosen.orderBy("collection", "_place").collect():
        own = books.setdefault(r.collection, [])
        if not own or len(own[0]) == len(r.vector):
            own.append(np.array(r.vector))
    books = {name: np.array(own) for name, own in books.items()}
    held = vectors.sparkSession.sparkContext.broadcast(books)
    columns = ["collection", "id", "vector", *([payload] if payload else [])]
    source = kept.select(*columns)
    kinds = [*source.dtypes, ("block", "int"), ("distance", "double")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vectors = batch.column(0).to_pylist(), batch.column(2)
            block, distance = np.full(len(names), -1, np.int32), np.zeros(len(names))
            for name in set(names):
                book = held.value.get(name)
                if book is None:
                    continue
                at = [i for i, own in enumerate(names) if own == name and len(vectors[i]) == book.shape[1] and vectors[i].values.null_count == 0]
                if not at:
                    continue
                x = np.array([vectors[i].values.to_numpy(zero_copy_only=False) for i in at], np.float64)
                finite = np.isfinite(x).all(axis=1)
                at, x = np.array(at)[finite], x[finite]
                apart = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)[None, :], 0)
                block[at] = apart.argmin(axis=1)
                distance[at] = np.sqrt(((x - book[block[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(distance)], [name for name, _ in kinds])

    rows = cut(source.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in kinds)))
    value = F.col(payload) if payload else F.lit(None).cast("int")
    stats = rows.groupBy("collection", "block").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min(value).alias("low"), F.max(value).alias("high"))
    known = vectors.sparkSession.createDataFrame([(name, i, c.tolist()) for name, book in books.items() for i, c in enumerate(book)], "collection string, block int, centre array<double>")
    return VectorBlocks(rows.drop("distance"), cut(stats.join(known, ["collection", "block"], "left")), payload)


def _bounds(blocks: VectorBlocks, queries: DataFrame, low, high) -> DataFrame:
    """``query_id, collection, block, n, bound`` of the blocks that the filter leaves."""
    stats = blocks.stats
    if low is not None:
        stats = stats.where(F.col("high") >= low)
    if high is not None:
        stats = stats.where(F.col("low") <= high)
    own = queries.withColumn("_length", F.sqrt(inner_product(F.col("query"), F.col("query"))))
    # a block of no bound, and a query of another length, give no number: read
    bound = inner_product(F.col("centre"), F.col("query")) + F.col("_length") * F.col("radius")
    # a bounded number of rows of each collection
    pairs = own.join(F.broadcast(stats), "collection")
    return pairs.select("query_id", "collection", "block", "n", F.when(F.col("block") >= 0, F.coalesce(F.nanvl(bound, F.lit(float("inf"))), F.lit(float("inf")))).otherwise(F.lit(float("inf"))).alias("bound"))


def _scored(blocks: VectorBlocks, queries: DataFrame, pairs: DataFrame, k: int, low, high) -> DataFrame:
    """Best ``k`` of each query and collection in the blocks of ``pairs``."""
    rows = blocks.rows
    if low is not None:
        rows = rows.where(F.col(blocks.payload) >= low)
    if high is not None:
        rows = rows.where(F.col(blocks.payload) <= high)
    asked = pairs.select("query_id", "collection", "block").join(queries.select("query_id", "collection", "query"), ["query_id", "collection"])
    few = pairs.count() <= SMALL // 16
    joined = rows.join(F.broadcast(asked) if few else asked, ["collection", "block"])
    w = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id")
    scored = joined.select("query_id", "collection", "id", F.round(inner_product(F.col("vector"), F.col("query")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(blocks: VectorBlocks, queries: DataFrame, k: int, low=None, high=None) -> tuple[DataFrame, DataFrame]:
    """``query_id, collection, id, score, rank``, exactly as a scan gives them, and ``query_id, collection, rows_read, rows`` of each query.

    ``queries``: ``query_id, collection, query``. ``low`` and ``high`` bound the payload column
    (both ends count; None: open). First the blocks with the greatest bounds are read, until they hold ``k`` rows;
    then those whose bound reaches the k-th score found there.
    """
    bounds = cut(_bounds(blocks, queries, low, high))
    by_bound = Window.partitionBy("query_id", "collection").orderBy(F.desc("bound"), "block")
    ordered = bounds.withColumn("_before", F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = cut(ordered.where(F.col("_before") < k).drop("_before"))
    found = cut(_scored(blocks, queries, first, k, low, high))
    least = found.groupBy("query_id", "collection").agg(F.when((F.count("score") >= k), F.min("score")).alias("_least"))
    rest = bounds.join(first.select("query_id", "collection", "block"), ["query_id", "collection", "block"], "left_anti").join(least, ["query_id", "collection"], "left")
    second = cut(rest.where(F.col("_least").isNull() | (F.col("bound") + SLACK * F.greatest(F.lit(1.0), F.abs("bound")) >= F.col("_least"))).drop("_least"))
    more = _scored(blocks, queries, second, k, low, high)
    w = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id")
    hits = found.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    read = first.unionByName(second).groupBy("query_id", "collection").agg(F.sum("n").alias("rows_read"))
    total = blocks.stats.groupBy("collection").agg(F.sum("n").alias("rows"))
    shares = queries.select("query_id", "collection").join(read, ["query_id", "collection"], "left").join(total, "collection", "left")
    return hits, shares.select("query_id", "collection", F.coalesce("rows_read", F.lit(0)).alias("rows_read"), F.coalesce("rows", F.lit(0)).alias("rows"))
