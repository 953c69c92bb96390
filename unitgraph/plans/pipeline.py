"""Read, embed and upsert as one bounded pass, and answers that come in pieces (ST6, SC16, K4).

In each task the three steps overlap, as one waits for a model and another for a vector store,
but never run away from one another: of batches, at most ``read_ahead`` wait to be embedded, ``embedded_ahead`` to be
written, and ``in_flight`` are being written. What was tried twice is one point, as points are known by their id.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import chain
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding import Embedder


class VectorSink(Protocol):
    def upsert(self, points: pa.RecordBatch) -> None:
        """Write points (``id``, the payload columns, ``vector``); a point that is there is replaced."""


class ParquetSink:
    """A sink that writes each batch of points to a file named after their ids, so that a batch tried again replaces its file."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").rstrip("/")

    def upsert(self, points: pa.RecordBatch) -> None:
        os.makedirs(self.folder, exist_ok=True)
        name = hashlib.sha256("\n".join(map(str, points.column("id").to_pylist())).encode()).hexdigest()[:32]
        pq.write_table(pa.Table.from_batches([points]), f"{self.folder}/{name}.tmp")
        os.replace(f"{self.folder}/{name}.tmp", f"{self.folder}/{name}.parquet")


def _tried(step: Callable[[], object], attempts: int, pause: float) -> tuple[object, int, str | None]:
    """A step's result, the attempts it took, and the last error if none went well."""
    for attempt in range(1, attempts + 1):
        try:
            return step(), attempt, None
        except Exception as e:  # noqa: BLE001  what a store or a model answers is data
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                time.sleep(pause * 2 ** (attempt - 1))
    return None, attempts, error


def in_order(items: Iterator, step: Callable, pool: ThreadPoolExecutor, ahead: int) -> Iterator:
    """``step`` of each item, in order, with at most ``ahead`` items taken from ``items`` and not yielded."""
    waiting: deque[Future] = deque()
    try:
        for item in items:
            waiting.append(pool.submit(step, item))
            if len(waiting) >= ahead:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        for f in waiting:
            f.cancel()


def upsert_vectors(
    texts: DataFrame, embedder: Embedder, sink: Callable[[], VectorSink], id_col: str = "id", text_col: str = "text",
    batch: int = 256, read_ahead: int = 2, embedded_ahead: int = 4, in_flight: int = 3, attempts: int = 3, pause: float = 0.1,
) -> DataFrame:
    """``id, written, attempts, error`` of each row of ``texts``, whose vectors the sink takes with the other columns as payload.

    ``sink`` makes a sink, once a task. Null texts are embedded as empty ones. A batch whose
    embedding or writing fails ``attempts`` times is a result like others; the next ones go on.
    """
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sink()
        parts = chain.from_iterable((b.slice(at, batch) for at in range(0, b.num_rows, batch)) for b in batches)

        def embedded(part: pa.RecordBatch):
            made, tries, error = _tried(lambda: embedder.encode([t or "" for t in part.column(names.index(text_col)).to_pylist()]), attempts, pause)
            return part, made, tries, error

        def written(step):
            part, vectors, tries, error = step
            if error is None:
                kept = [(n, c) for n, c in zip(names, part.columns) if n not in (id_col, text_col)]
                points = pa.RecordBatch.from_arrays([part.column(names.index(id_col)), *[c for _, c in kept], pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], ["id", *[n for n, _ in kept], "vector"])
                _, tries, error = _tried(lambda: own.upsert(points), attempts, pause)
            n = part.num_rows
            return pa.RecordBatch.from_arrays([part.column(names.index(id_col)), pa.array([error is None] * n), pa.array([tries] * n, pa.int32()), pa.array([error] * n, pa.string())], ["id", "written", "attempts", "error"])

        # one thread embeds, as a model takes one batch at a time
        with ThreadPoolExecutor(1) as model, ThreadPoolExecutor(in_flight) as store:
            yield from in_order(in_order(parts, embedded, model, read_ahead + 1), written, store, embedded_ahead + in_flight)

    kind = dict(texts.dtypes)[id_col]
    return texts.mapInArrow(run, f"id {kind}, written boolean, attempts int, error string")


class StreamingLlm(Protocol):
    def stream(self, prompt: str) -> Iterator[str]:
        """Pieces of an answer as they come."""

    def models(self) -> list[str]:
        """Names of the models that can answer."""


def stream_answers(prompts: DataFrame, client: Callable[[], StreamingLlm], id_col: str = "id", prompt_col: str = "prompt", in_flight: int = 3) -> DataFrame:
    """``id, place, piece, last, error``: the pieces of each answer, numbered from 0, the last one marked (SC16).

    At most ``in_flight`` prompts of a task are being answered. An error ends an answer: its last
    row has an empty piece and the error. Null prompts are empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

        def answered(row):
            pieces, error = [], None
            try:
                pieces = pieces_of(row[1] or "")
            except Exception as e:  # noqa: BLE001  a failed call is data
                error = f"{type(e).__name__}: {e}"
            return row[0], pieces, error

        def pieces_of(prompt: str) -> list[str]:
            return list(own.stream(prompt))

        with ThreadPoolExecutor(in_flight) as pool:
            for key, pieces, error in in_order(rows, answered, pool, in_flight):
                shown = pieces if error is None and pieces else [*pieces, ""]
                n = len(shown)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, type_of), pa.array(range(n), pa.int32()), pa.array(shown, pa.string()), pa.array([k == n - 1 for k in range(n)]), pa.array([None] * (n - 1) + [error], pa.string())], ["id", "place", "piece", "last", "error"])

    from pyspark.sql.pandas.types import to_arrow_type

    type_of = to_arrow_type(prompts.schema[id_col].dataType)
    kind = dict(prompts.dtypes)[id_col]
    return prompts.select(F.col(id_col), F.col(prompt_col)).mapInArrow(run, f"id {kind}, place int, piece string, last boolean, error string")


def model_list(spark: SparkSession, client: Callable[[], StreamingLlm]) -> DataFrame:
    """``model``, by name; no rows if the service doesn't answer (SC16)."""
    names, _, _ = _tried(lambda: client().models(), 1, 0)
    return spark.createDataFrame([(n,) for n in sorted(names or [])], "model string")
