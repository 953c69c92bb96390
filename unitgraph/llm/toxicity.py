"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A text becomes ``FEATURES``: densities of a lexicon's hits, how near second persons stand to
them, rates of capitals, punctuation and obfuscated words. The lexicon is learned from
the labels: words that stand behind more different words in toxic texts than in others, by
far (copies of one text count once that way). Features of labelled rows are made with
the lexicon of the other half of the rows, so that trees don't trust words that they have seen.
Trees and calibration are Spark's; a fifth of the rows is kept for the calibration.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_names

FEATURES = (
    "strong_density", "strong_hits", "strong_words", "weak_density", "weak_hits", "weight_density", "near_second_person", "second_person_density",
    "capital_share", "capital_words", "punctuation_share", "exclamation_share", "obfuscated_hits", "obfuscated_density", "masked_words", "stretched_words", "log_words",
)
#: Words that address somebody, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner euch euer eure tu toi ton vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
#: Words on each side of a hit in which a second person counts as near.
NEAR = 3
#: Standard errors by which a word's log odds are lowered, and lowered log odds from which it is a strong one.
CAUTION, STRONG = 1.28, 2.5
_EDGE = string.punctuation + "«»„“”‘’…¡¿–—"
_AGAIN, _STRETCHED, _NO_LETTER = re.compile(r"(.)\1+"), re.compile(r"([^\W\d_])\1\1"), re.compile(r"[\W\d_]+")
_CAPITALS, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_CAPITALS[65:91] = _LETTERS[65:91] = _LETTERS[97:123] = True
_PUNCTUATION = np.array([chr(c) in string.punctuation for c in range(256)])


@dataclass(frozen=True)
class Lexicon:
    """``words``: weight (lowered log odds) of each word, and whether it is strong; ``folded``: words by their form without repeated letters."""

    words: dict[str, tuple[float, bool]]
    folded: dict[str, str]

    @classmethod
    def of(cls, rows: list[tuple[str, float]]) -> Lexicon:
        """From ``word, weight``."""
        words = {w: (float(r), r >= STRONG) for w, r in rows}
        return cls(words, {_AGAIN.sub(r"\1", w): w for w in sorted(words, reverse=True)})

    def unmasked(self, word: str) -> str | None:
        """The lexicon word that stands behind look-alike characters, marks between letters and repeated letters."""
        plain = _NO_LETTER.sub("", word.translate(LOOKALIKES))
        if plain in self.words:
            return plain
        return self.folded.get(_AGAIN.sub(r"\1", plain)) if len(plain) > 2 else None


def words_of(text: str) -> list[str]:
    """Words in lower case, without punctuation at their ends; one that is punctuation only is empty."""
    return [w.strip(_EDGE) for w in text.lower().split()]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The ``FEATURES`` of a whole text; all 0 for one without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    known = lexicon.words
    hits = [(i, w) for i, w in enumerate(words) if w in known]
    odd = [(i, w) for i, w in enumerate(words) if w and not w.isalpha()]
    masked = [(i, w) for i, w in odd if not w.isdigit() and any(c.isalpha() for c in w)]
    stretched = [(i, w) for i, w in enumerate(words) if _STRETCHED.search(w)] if _STRETCHED.search(text) else []
    hidden = [(i, real) for i, w in {*masked, *stretched} if w not in known and (real := lexicon.unmasked(w))]
    # letters that stand alone, as in "b a d"
    alone, run = [i for i, w in enumerate(words) if len(w) == 1], []
    for i in [*alone, -1]:
        if run and i != run[-1] + 1:
            if len(run) > 2 and (real := lexicon.unmasked("".join(words[k] for k in run))):
                hidden.append((run[0], real))
            run = []
        run.append(i)
    every = hits + hidden
    strong = [w for _, w in every if known[w][1]]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = {i + k for i in second for k in range(-NEAR, NEAR + 1)} if every else ()
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    letters, size = max(int(count[_LETTERS].sum()), 1), int(count.sum())
    return [
        len(strong) / n, float(np.log1p(len(strong))), float(np.log1p(len(set(strong)))), (len(every) - len(strong)) / n, float(np.log1p(len(every) - len(strong))),
        sum(known[w][0] for _, w in every) / n, sum(i in near for i, _ in every) / n, len(second) / n,
        int(count[_CAPITALS].sum()) / letters, sum(map(str.isupper, text.split())) / n, int(count[_PUNCTUATION].sum()) / size, int(count[33]) / size,
        float(np.log1p(len(hidden))), len(hidden) / n, len(masked) / n, len(stretched) / n, float(np.log1p(n)),
    ]


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """``id, text, label, half, calibrates`` of the labelled rows that the model is fitted on, kept in the shared folder."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    # at most sample_rows small rows: a bounded broadcast
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    one = texts.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    draw = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(10))
    return materialize(one.select("id", "text", "label", (draw % 2).cast("int").alias("half"), (draw >= 8).alias("calibrates")), "toxicity")


def _neighbours(rows: DataFrame) -> DataFrame:
    """``word, half, label, beside``: the different pairs of words before each word, as CRC-32, by half and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = words_of(text)
                pairs = list(dict.fromkeys((w, f"{a} {b}") for a, b, w in zip(["", "", *words], ["", *words], words) if len(w) > 2))
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in pairs], pa.string()), pa.array([half] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array([crc32(b.encode("utf-8", "replace")) for _, b in pairs], pa.int64())],
                    ["word", "half", "label", "beside"],
                )

    return rows.select("text", "label", "half").mapInArrow(run, "word string, half int, label int, beside bigint")


def lexicons(rows: DataFrame, size: int = 2000, min_contexts: int = 3, min_weight: float = 1.5) -> list[Lexicon]:
    """Lexicons of half 0, of half 1 and of all rows: the at most ``size`` words with the greatest weight.

    Counts are of different pairs of words before a word, in toxic and other texts; a word's weight is the
    log ratio of its odds, lowered by ``CAUTION`` standard errors. Words with fewer than
    ``min_contexts`` in toxic texts, or a weight below ``min_weight``, are left out.
    """
    counts = _neighbours(rows).distinct().groupBy("word").agg(*[F.count_if((F.col("half") == h) & (F.col("label") == y)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)])
    counts = materialize(counts, "lexicon")
    found = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, other = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (1, 0))
        own = counts.select("word", toxic.alias("t"), other.alias("f"))
        total = own.agg(F.sum("t").alias("all_t"), F.sum("f").alias("all_f"))  # one row
        odds = F.log((F.col("t") + 0.5) / (F.col("all_t") - F.col("t") + 0.5)) - F.log((F.col("f") + 0.5) / (F.col("all_f") - F.col("f") + 0.5))
        rated = own.join(F.broadcast(total)).where(F.col("t") >= min_contexts).select("word", F.round(odds - CAUTION * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("f") + 0.5)), 9).alias("weight"))
        best = rated.where(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "word").limit(size)
        found.append(Lexicon.of([tuple(r) for r in best.collect()]))
    return found


def _featured(rows: DataFrame, text_col: str, lexicon_col: str | None, held: list[Lexicon], own: str) -> DataFrame:
    """``rows`` without the text, and ``own``, its features as an array; ``lexicon_col`` numbers the lexicon to use, or the last is."""
    kept = [c for c in rows.columns if c != text_col]
    # at most three lexicons of a bounded number of words
    shared = rows.sparkSession.sparkContext.broadcast(held)
    which = F.lit(len(held) - 1) if lexicon_col is None else F.col(lexicon_col)
    wide = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), which.cast("int").alias("which"))
    kinds = [*wide.dtypes[:-2], ("features", "array<double>")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            made = [features(t.as_py(), shared.value[k]) for t, k in zip(batch.column(n), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.list_(pa.float64()))], [name for name, _ in kinds])

    return wide.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds)).toDF(*kept, own)


@dataclass(frozen=True)
class Model:
    """Lexicon, trees and calibration; without trees every score is ``share``."""

    lexicon: Lexicon
    share: float
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None

    def applied(self, rows: DataFrame, vector: str, to: str) -> DataFrame:
        """``rows`` with the score of column ``vector`` as ``to``."""
        margin = vector_to_array("rawPrediction")[1]
        scored = self.curve.transform(self.trees.transform(rows.withColumn("features", array_to_vector(vector))).withColumn("margin", margin))
        return scored.withColumn(to, F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 10_000, trees: int = 20, depth: int = 3, seed: int = 7, **options,
) -> Model:
    """Fit on the at most ``sample_rows`` labelled rows with the smallest hash of their id, of those not held out.

    Ids labelled both 0 and 1 count as 0; null ids, null labels and labels other than 0 and 1 are
    left out; of rows that share an id, the smallest text counts. If the sample, or the part that trees
    learn from, has one label only, every score is the smoothed share of label 1. ``options`` go to :func:`lexicons`.
    """
    rows = _sample(docs, labels, id_col, text_col, label_col, sample_rows)
    seen = {(r["calibrates"], r["label"]): r["count"] for r in rows.groupBy("calibrates", "label").count().collect()}
    toxic, other = (sum(seen.get((part, y), 0) for part in (False, True)) for y in (1, 0))
    share = (toxic + 1) / (toxic + other + 2)
    if not seen.get((False, 1)) or not seen.get((False, 0)):
        return Model(Lexicon({}, {}), share)
    first, second, whole = lexicons(rows, **options)
    # rows of a half are seen through the lexicon of the other one
    made = materialize(_featured(rows, "text", "half", [second, first], "values").select("label", "calibrates", array_to_vector("values").alias("features")), "toxicity")
    learner = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=2)
    fitted = learner.fit(made.where(~F.col("calibrates")))
    on = made.where("calibrates") if seen.get((True, 1)) and seen.get((True, 0)) else made
    margins = fitted.transform(on).select(vector_to_array("rawPrediction")[1].alias("margin"), F.col("label").cast("double").alias("label"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins)
    return Model(whole, share, fitted, curve)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) added or replaced. Null texts are scored as empty ones."""
    kept = [c for c in docs.columns if c != score_col]
    if model.trees is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(score_col, F.lit(model.share))
    text, values, to = new_names(docs, 3)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(text))
    # the models' column names are theirs: own columns are numbered meanwhile
    numbered = _featured(rows, text, None, [model.lexicon], values).toDF(*[f"c{i}" for i in range(len(kept))], values)
    out = model.applied(numbered, values, to)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col(to).alias(score_col))


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs`` (repeated rows and null ids included)."""
    model = train(docs, labels, id_col, text_col, **options)
    # only the text reaches the model
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
