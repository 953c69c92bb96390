"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

* Both halves of the vectors are quantised on their own (k-means on a bounded sample);
  a pair of centroids is a cell, and every row is indexed under its cell.
* A query visits cells by the sum of its halves' distances to the two centroids, taken
  off a heap (a pair enters once both its neighbours before it have come out), until the
  visited cells hold ``share`` of all rows. With ``share=1`` the search is exact.
* The table of cell sizes has at most ``k * k`` rows. From it, cells become blocks of about
  ``block_rows`` rows, large cells several of them; queries go to the blocks of their
  cells, and a block meets the queries in bounded chunks. In a task the products are one
  matrix product, rows in cells that a query didn't visit are left out, and the best are
  scored again in a fixed order of addition.
* Of equal vectors only the ``top + 1`` smallest ids are indexed: no other can be in a result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def kmeans(data: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of at most ``k`` clusters; empty ones restart at the farthest row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(data))
    centres = data[rng.choice(len(data), k, replace=False)].copy() if k else data[:0]
    for _ in range(rounds if data.shape[1] else 0):
        far = (centres**2).sum(1)[None] - 2 * data @ centres.T
        own = far.argmin(1)
        for j in range(k):
            mine = own == j
            centres[j] = data[mine].mean(0) if mine.any() else data[far[np.arange(len(data)), own].argmax()]
    return centres


class MultiIndex:
    """Two codebooks; cells are numbered ``i * k2 + j``."""

    def __init__(self, sample: np.ndarray, k: int = 32):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)]
        self.cells = len(self.books[0]) * len(self.books[1])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        parts = [((b**2).sum(1)[None] - 2 * h @ b.T).argmin(1) for b, h in zip(self.books, (x[:, : self.half], x[:, self.half :]))]
        return parts[0] * len(self.books[1]) + parts[1]

    def visit(self, q: np.ndarray, sizes: list[int], enough: float) -> list[int]:
        """Cells in order of summed distance until they hold ``enough`` rows."""
        # the larger the product with the centroids the nearer
        near = [-(b @ h) for b, h in zip(self.books, (q[: self.half], q[self.half :]))]
        order = [np.argsort(n, kind="stable").tolist() for n in near]
        near = [n[o].tolist() for n, o in zip(near, order)]
        k1, k2 = len(order[0]), len(order[1])
        heap, out, held, done = [(near[0][0] + near[1][0], 0, 0)], [], 0, [0] * k1
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = order[0][i] * k2 + order[1][j]
            if sizes[cell]:
                out.append(cell)
                held += sizes[cell]
            done[i] = j + 1
            if i + 1 < k1 and done[i + 1] == j:
                heapq.heappush(heap, (near[0][i + 1] + near[1][j], i + 1, j))
            if j + 1 < k2 and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (near[0][i] + near[1][j + 1], i, j + 1))
        return out


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` (doubles as binary): rows with an id and a finite vector that isn't zero, of the table's most common length.

    Rows that are equal count once.
    """
    v = F.col("v")
    good = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    found = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    length = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    # + 0.0 makes one zero of both
    return found.where(F.size("v") == d).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), d)


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, *, k: int = 32, share: float = 0.55, least: int = 4096, sample_rows: int = 8192, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found of each row whose id is divisible by ``every``.

    Candidates are all rows with another id. Nearest first, ties to the smaller id; all
    candidates if there are fewer. Rows without an id, and vectors that are null, zero, of
    another length than most, or hold nulls or non-finite numbers take no part. Equal rows
    (id and vector) count once. A query visits cells until they hold ``share`` of the
    indexed rows, and at least ``least`` rows. The codebooks are fitted on the at most
    ``sample_rows`` rows with the smallest hash.
    """
    spark = rows.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    valid = usable(rows, id_col, vector_col)
    same = Window.partitionBy("v").orderBy("id")
    kept = valid.withColumn("n", F.row_number().over(same)).where(F.col("n") <= top + 1)
    sample = valid.orderBy(F.xxhash64("v"), "id").limit(sample_rows).select("v").collect()  # bounded
    if not sample:
        return spark.createDataFrame([], result)
    d = len(sample[0]["v"])
    index = MultiIndex(np.array([r["v"] for r in sample], np.float64).reshape(-1, d), k)
    books = spark.sparkContext.broadcast(index)  # 2 * k half vectors

    def assign(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(books.value.assign(x).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cell", "vec"])

    indexed = materialize(kept.select("id", "v").mapInArrow(assign, "id bigint, cell int, vec binary"), "multi-index")
    sizes = [0] * index.cells
    for r in indexed.groupBy("cell").count().collect():  # at most k * k rows
        sizes[r["cell"]] = r["count"]
    total = sum(sizes)
    block_rows = min(block_rows, max(256, total // 64))  # small tables in many blocks too: only the layout differs
    first, parts, filled, block = [0] * index.cells, [1] * index.cells, 0, 0
    for cell, n in enumerate(sizes):
        if n > block_rows:  # a large cell: blocks of its own
            block += bool(filled)
            first[cell], parts[cell] = block, -(-n // block_rows)
            block, filled = block + parts[cell], 0
        else:
            if filled + n > block_rows:
                block, filled = block + 1, 0
            first[cell], filled = block, filled + n
    queries = valid.where(F.col("id") % every == 0)
    chunks = max(1, -(-queries.count() // query_rows))
    layout = spark.sparkContext.broadcast((sizes, np.array(first), np.array(parts), max(share * total, min(least, total))))

    def deal(batches):
        for batch in batches:
            out = ([], [], [], [])
            sizes, first, parts, enough = layout.value
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for i, q in zip(batch.column(0).to_pylist(), x):
                cells = np.array(books.value.visit(q, sizes, enough))
                bits = np.zeros(index_cells, np.uint8)
                bits[cells] = 1
                mask = np.packbits(bits).tobytes()
                blocks = {b for f, p in zip(first[cells].tolist(), parts[cells].tolist()) for b in range(f, f + p)}
                for b in sorted(blocks):
                    for column, value in zip(out, (b, i, q.tobytes(), mask)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "query_id", "q", "mask"])

    index_cells = index.cells
    dealt = queries.select("id", "v").mapInArrow(deal, "block bigint, query_id bigint, q binary, mask binary").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    f = F.element_at(F.array(*map(F.lit, first)), F.col("cell") + 1)
    p = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)
    blocks = indexed.withColumn("block", (f + F.pmod(F.xxhash64("id"), p.cast("bigint"))).cast("bigint")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        ids, cell = left["id"].to_numpy(), left["cell"].to_numpy()
        x = _matrix(left["vec"].combine_chunks(), d)
        q_ids, q = right["query_id"].to_numpy(), _matrix(right["q"].combine_chunks(), d)
        masks = np.frombuffer(b"".join(right["mask"].to_pylist()), np.uint8).reshape(len(q), -1)
        out = ([], [], [])
        for at in range(0, len(q), 128):
            rough = q[at : at + 128] @ x.T
            visited = np.unpackbits(masks[at : at + 128], axis=1)[:, cell].astype(bool) & (q_ids[at : at + 128, None] != ids[None])
            rough[~visited] = -np.inf
            for row, (i, own) in enumerate(zip(q_ids[at : at + 128], q[at : at + 128])):
                scores = rough[row]
                if len(scores) > top:
                    bar = np.partition(scores, -top)[-top]
                    best = np.flatnonzero((scores >= bar - 1e-9 * (1 + abs(bar))) & (scores > -np.inf)) if bar > -np.inf else np.flatnonzero(scores > -np.inf)
                else:
                    best = np.flatnonzero(scores > -np.inf)
                exact = (x[best] * own).sum(axis=1)
                order = np.lexsort((ids[best], -exact))[:top]
                out[0].append(np.full(len(order), i))
                out[1].append(ids[best][order])
                out[2].append(exact[order])
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], names)

    found = blocks.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
