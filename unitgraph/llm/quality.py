"""Quality classifier: naive Bayes features in a linear support vector machine.

A text is the set of its byte n-grams (1 to ``MAX_N``) and of its repeat grams (a word
that comes 2, 3, ... times in a row), hashed to ``BUCKETS``. Indicators are scaled by
the log ratio of the classes' smoothed counts, each text is brought to at most unit
length (short ones stay shorter, so little evidence moves a score little), and a
hinge-loss linear model is fitted by dual coordinate descent. Margins become probabilities by a logistic curve fitted on rows that the
descent didn't see. The model is two arrays of ``SIZE`` numbers, whatever the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_names

BUCKETS = 1 << 18
MAX_N = 4
#: Behind the hashed buckets: a word comes 2, 3, ... REPEATS + 1 times in a row.
REPEATS = 8
SIZE = BUCKETS + REPEATS
BLOCK = 1 << 20
_SPACE = re.compile(rb"\s")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted bucket numbers of a text's n-grams. ``seen``: scratch of ``SIZE`` zeros, zero again afterwards."""
    data = np.frombuffer(text, np.uint8)
    run, longest, before = 0, 0, None
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + MAX_N - 1].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(min(MAX_N, len(part))):
            h = (h[: len(part) - n] ^ (part[n:] + np.uint32(1))) * _MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            seen[(h * np.uint32(0x2C1B3C6D)) >> np.uint32(14)] = 1
    at = 0
    while at < len(text):
        # a block ends before white space, so that no word is cut
        stop = _SPACE.search(text, at + BLOCK)
        end = stop.start() if stop else len(text)
        for word in text[at:end].split():
            run = run + 1 if word == before else 0
            before = word
            if run > longest:
                longest = run
        at = end
    seen[BUCKETS : BUCKETS + min(longest, REPEATS)] = 1
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


@dataclass(frozen=True)
class Model:
    """``weight``: learned weight times log-count ratio; ``square``: the ratio's square, for the length of a text; ``floor`` is added to that."""

    weight: np.ndarray
    square: np.ndarray
    floor: float
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = (float(self.square[found].sum(dtype=np.float64)) + self.floor) ** 0.5
        return (float(self.weight[found].sum(dtype=np.float64)) / length if length else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.offset
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def _descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, floor: float, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss machine with a bias feature of 1; returns weights of unscaled rows, bias."""
    # scaled rows are made when they are needed: only bucket numbers are held
    squares = np.array([float((ratio[x] ** 2).sum()) for x in rows])
    scale = 1 / np.sqrt(np.where(squares + floor > 0, squares + floor, 1.0))
    diagonal = squares * scale**2 + 1.0
    w, bias, alpha, rng = np.zeros(SIZE), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            values = ratio[rows[i]] * scale[i]
            gradient = y[i] * (float(w[rows[i]] @ values) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                old = alpha[i]
                alpha[i] = min(max(old - gradient / diagonal[i], 0.0), cost[i])
                step = (alpha[i] - old) * y[i]
                w[rows[i]] += step * values
                bias += step
        if worst < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), by Newton steps on smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g, s = p - target, p * (1 - p) + 1e-9
        h11, h12, h22 = float((s * margin * margin).sum()) + 1e-6, float((s * margin).sum()), float(s.sum()) + 1e-6
        g1, g2 = float((g * margin).sum()), float(g.sum())
        det = h11 * h22 - h12 * h12
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        limit = max(1.0, abs(da) / 5, abs(db) / 5)
        a, b = a - da / limit, b - db / limit
        if abs(da) + abs(db) < 1e-7:
            break
    return max(a, 0.0), b


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> Model:
    """Fit on rows of bucket numbers and 0 / 1 labels. With one class or none, every score is the smoothed share of label 1."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not (y > 0).any() or not (y < 0).any():
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for side in (1.0, -1.0):
        own = rng.permutation(np.flatnonzero(y == side))
        held[own[: len(own) // 4]] = True
    train = np.flatnonzero(~held)
    counts = {side: np.full(SIZE, smoothing) for side in (1.0, -1.0)}
    for i in train:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    ratio[(counts[1.0] == smoothing) & (counts[-1.0] == smoothing)] = 0
    floor = float(np.median([(ratio[rows[i]] ** 2).sum() for i in train]))
    w, bias = _descent([rows[i] for i in train], y[train], ratio, floor, np.full(len(train), cost), epochs, seed)
    rough = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), floor, bias, 1.0, 0.0)
    on = np.flatnonzero(held) if held.any() else train
    slope, offset = _logistic(np.array([rough.margin(rows[i]) for i in on]), y[on])
    return Model(rough.weight, rough.square, floor, bias, slope, offset)


def held_out(id_col):
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 5000, **options) -> Model:
    """Fit on the at most ``sample_rows`` labelled rows with the smallest hash of their id, of those not held out.

    Ids labelled both 0 and 1 count as 0; null ids, null labels and labels other than
    0 and 1 are left out; of rows that share an id, the smallest text counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    # at most sample_rows small rows: a bounded broadcast
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label"))

    def run(batches):
        seen = np.zeros(SIZE, np.uint8)
        for batch in batches:
            found = [pa.py_buffer(features(t.as_py(), seen).astype(np.int32).tobytes()).to_pybytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "label", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(run, f"id {kind}, label int, found binary").collect()
    rows.sort(key=lambda r: r["id"])
    return fit([np.frombuffer(r["found"], np.int32) for r in rows], np.array([r["label"] for r in rows], int), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) added or replaced. Null texts are scored as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the data
    kept = [c for c in docs.columns if c != score_col]
    # numbered names in the Arrow pass, which doesn't take any name
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).cast("binary").alias("text"))
    kinds = [*rows.dtypes[:-1], ("score", "double")]

    def run(batches):
        seen, own = np.zeros(SIZE, np.uint8), held.value
        for batch in batches:
            n = batch.num_columns - 1
            scores = [own.score(features(t.as_py() or b"", seen)) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], [name for name, _ in kinds])

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds)).toDF(*kept, score_col)


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs`` (repeated rows and null ids included)."""
    model = train(docs, labels, id_col, text_col, **options)
    # only the text reaches the model
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text"), model)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``; same columns, whatever their names.

    Null texts are scored as empty ones; null ids and repeated rows are rows like others.
    """
    model = train(docs, labels, id_col, text_col, **options)
    (own,) = new_names(docs, 1)
    return score(docs, model, text_col, own).where(F.col(own) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
