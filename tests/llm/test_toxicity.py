"""Toxicity: features by definition, held-out accuracy, and odd input."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from unitgraph.llm import queries, toxicity
from unitgraph.llm.toxicity import FEATURES, Lexicon, features

DATA = "/root/testdata/sf0.01"
LEXICON = Lexicon.of([("idiot", 5.0), ("stupid", 4.0), ("meh", 1.7)])


def of(text):
    return dict(zip(FEATURES, features(text, LEXICON)))


def test_densities_and_second_person():
    x = of("You are an idiot, I say. The stupid weather is meh")
    assert x["strong_density"] == 2 / 11 and x["weak_density"] == 1 / 11 and x["strong_words"] == math.log1p(2)
    assert x["weight_density"] == pytest.approx(10.7 / 11) and x["second_person_density"] == 1 / 11
    # only the first is within three words of "you"
    assert x["near_second_person"] == 1 / 11 and x["log_words"] == math.log1p(11)


def test_rates():
    x = of("NO Way!! ok")
    assert x["capital_words"] == 1 / 3 and x["capital_share"] == 3 / 7
    assert x["exclamation_share"] == x["punctuation_share"] == 2 / 11


@pytest.mark.parametrize("word", ["1d10t", "i.d.i.o.t", "id!ot", "IDIOOOT", "i d i o t", "@idi0t!", "Idiot-"])
def test_obfuscated_words(word):
    x = of(f"such {word} there")
    assert x["strong_hits"] == math.log1p(1)
    assert (x["obfuscated_hits"] > 0) == (word != "Idiot-")


@pytest.mark.parametrize("word", ["555-1234", "a,b", "x y z", "...", "1d", "don't", "é😀", "\x00"])
def test_other_odd_words_are_no_hits(word):
    assert of(f"such {word} there")["strong_hits"] == 0


def test_texts_without_words():
    for text in ("", " \n\t"):
        assert features(text, LEXICON) == [0.0] * len(FEATURES)
    assert all(map(math.isfinite, features("\ud800 !!! ...", LEXICON)))


def by_count(texts, labels):
    """The lexicon's rule, counted plainly."""
    contexts = {}
    for text, y in zip(texts, labels):
        words = toxicity.words_of(text)
        for a, b, w in zip(["", "", *words], ["", *words], words):
            if len(w) > 2:
                contexts.setdefault((w, y), set()).add((a, b))
    total = {y: sum(len(v) for (_, k), v in contexts.items() if k == y) for y in (0, 1)}
    found = {}
    for w in {w for w, _ in contexts}:
        t, f = (len(contexts.get((w, y), ())) for y in (1, 0))
        weight = math.log((t + 0.5) / (total[1] - t + 0.5)) - math.log((f + 0.5) / (total[0] - f + 0.5)) - toxicity.CAUTION * math.sqrt(1 / (t + 0.5) + 1 / (f + 0.5))
        if t >= 3 and weight >= 1.5:
            found[w] = weight
    return found


def test_lexicon_by_count(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(120):
        bad = rng.random() < 0.3
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["vile", "foul"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    rows = spark.createDataFrame([(t, y, 1) for t, y in zip(texts, labels)], "text string, label int, half int")
    _, half, whole = toxicity.lexicons(rows)
    want = by_count(texts, labels)
    assert set(want) == {"vile", "foul"}
    assert {w: r for w, (r, _) in whole.words.items()} == pytest.approx(want, abs=1e-8) and half == whole


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        words = [rng.choice("some plain words that say little of anything at all".split()) for _ in range(rng.randint(5, 60))]
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vile", "foul", "crud"])
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_and_no_leak(spark):
    rows = made(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert {k: r.held_out for k, r in got.items()} == {k: held(k) for k in got}
    own = [r for r in rows if held(r[0])]
    assert sum(got[k].predicted == y for k, _, y in own) > 0.97 * len(own) and all(0 <= r.score <= 1 for r in got.values())
    # labels of held-out rows aren't looked at
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    again = {r.doc_id: r.score for r in toxicity.predictions(docs, other).collect()}
    assert again == pytest.approx({k: r.score for k, r in got.items()}, abs=1e-9)


def test_odd_rows_and_names(spark):
    rows = made(200)
    docs = spark.createDataFrame(
        [(k, t, t, 1.0, "f") for k, t, _ in rows] + [(None, None, "", None, None), (None, "vile foul vile", "", 0.0, ""), (7, "plain", "", 0.0, ""), (900, "", "", 0.0, ""), (901, "word " * 200_000, "", 0.0, "")],
        "doc_id bigint, text string, features string, score double, prediction string",
    )
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None), (6, 9), (7, 0), (7, 1), (12345, 1)], "doc_id bigint, toxic int")
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id is None and not r.held_out for r in got) == 2
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.columns == ["doc_id", "text", "features", "prediction", "score"]
    assert sorted(scored.select("doc_id", "text", "features", "prediction").collect(), key=repr) == sorted(docs.select("doc_id", "text", "features", "prediction").collect(), key=repr)


@pytest.mark.parametrize("label", [None, 0, 1])
def test_without_both_labels(spark, label):
    docs = spark.createDataFrame([(k, t) for k, t, _ in made(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, label) for k in range(20)] if label is not None else [], "doc_id bigint, toxic int")
    n = sum(not held(k) for k in range(20)) if label is not None else 0
    assert {r.score for r in toxicity.predictions(docs, labels).collect()} == {((n if label else 0) + 1) / (n + 2)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.predictions(docs, labels).collect() == []


def test_whole_table(spark):
    got = queries.op13_toxicity(spark, DATA)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    # of the languages with more than a few toxic rows, as this small table has for one
    own = got.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    assert sum(r.predicted == r.toxic for r in own) >= 0.9 * len(own) and sum(r.predicted and r.toxic for r in own) >= 3
