import re
from collections import Counter

import pytest

import corpus_pipeline as P
from unitgraph.llm import quality, simhash
from unitgraph.llm.shared import materialize

from .test_line_dedup import plain_dedup, words_of
from .test_mixing import plain_targets
from .test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], DATA), "test-stage"))
    return out


def test_columns(steps):
    for step in steps[1:-1]:
        assert step.dtypes == steps[0].dtypes


def test_quality_stage(spark, steps):
    docs, kept = steps[0].collect(), {r.doc_id for r in steps[1].collect()}
    model = quality.train(steps[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    seen = quality.np.zeros(quality.SIZE, quality.np.uint8)
    assert kept == {r.doc_id for r in docs if model.score(quality.features(r.text.encode(), seen)) >= 0.7}
    assert 0 < len(kept) < len(docs)


def test_line_stage(steps):
    """Against brute force over all pairs of lines: nothing more goes, and nearly all that should."""
    rows = [(r.doc_id, r.text) for r in steps[1].orderBy("doc_id").collect()]
    want = {}
    for (i, old), new in zip(rows, plain_dedup(rows)):
        if new == old or words_of(new):
            want[i] = new
    got = {r.doc_id: r.text for r in steps[2].collect()}
    lines = lambda texts: Counter(line for t in texts.values() for line in t.split("\n") if words_of(line))
    kept, ideal, before = lines(got), lines(want), lines(dict(rows))
    assert (kept - ideal).total() <= 0.02 * (before - ideal).total() and (ideal - kept).total() <= (kept - ideal).total()
    assert set(want) <= set(got) | {i for i in want if want[i] != dict(rows)[i]} and got != dict(rows)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_duplicate_stage(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    roots = plain_components([plain_fingerprint(t, 5) for _, t in rows], 6)
    assert {r.doc_id for r in steps[3].collect()} == {rows[k][0] for k in set(roots)}


def test_near_duplicate_stage_on_copies(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(9, text, "en", "s", 1), (4, text + " more", "en", "s", 1), (5, "another text of five or six words", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in P.near_duplicate_stage(spark, docs, DATA).collect()} == {4, 5}


def test_mixing_stage(steps):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = steps[3].collect(), steps[4].collect()
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r.text)
    for r in after:
        taken[r.source] += size(r.text)
    largest = max(size(r.text) for r in before)
    for s, t in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_token_stage(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.public_vocabulary("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in steps[4].collect())
    got = steps[5].collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_run(spark, steps):
    got = P.run(spark, DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[5].collect()))


NAMES = ["row", "id", "k1", "gone", "fp", "component_id", "copies", "score", "_row", "_score", "own_0", "lines_removed", "size"]
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` int" for n in NAMES)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids and texts, names of the operators' own."""
    long = " ".join(f"word{i * i % 9973}" for i in range(60000))
    prose = "a plain sentence of several words that nobody would throw away"
    rows = [
        (1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (1, "another text with the same id as before it", "en", "s", 1), (None, prose, "en", "s", 1), (2, None, "en", "s", None), (3, "", None, "s", 0),
        (4, prose.upper(), "en", None, 1), (5, long, "en", "t", 1), (6, long + " end", "en", "t", 1), (7, " \t\n", "en", "t", 3), (None, None, None, None, None), (8, "短い 行", "ja", "u", 4),
    ]
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], FIELDS)


STAGE = dict(P.STAGES)


def plain(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in rows)


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_input(spark, name):
    docs = odd(spark)
    out = STAGE[name](spark, docs, DATA)
    rows = out.collect()
    if name != "BPE encoding":
        assert out.columns == docs.columns and {tuple(r)[5:] for r in rows} == {tuple(range(len(NAMES)))}
    before, prose, long = plain(docs.collect()), docs.first().text, next(r.text for r in docs.collect() if r.doc_id == 5)
    if name == "quality classifier":
        assert plain(rows) <= before and all(n in (0, before[k]) for k, n in plain(rows).items())
    elif name == "line dedup":
        got = plain(rows)
        assert got[1, prose, "en", "s"] == 2 and got[2, None, "en", "s"] == got[None, None, None, None] == got[3, "", None, "s"] == 1
        assert not any(r.doc_id in (4, 6) or r.doc_id is None and r.text for r in rows) and got[5, long, "en", "t"] == 1 and len(rows) == 9
    elif name == "SimHash near-dedup":
        got = plain(rows)
        assert got == Counter({(1, prose, "en", "s"): 1, (1, "another text with the same id as before it", "en", "s"): 1, (None, prose, "en", "s"): 1, (2, None, "en", "s"): 1, (5, long, "en", "t"): 1, (None, None, None, None): 1, (8, "短い 行", "ja", "u"): 1})
    elif name == "mixing sources":
        got = plain(rows)
        assert got and all(n <= 2 * before[k] for k, n in got.items())
        # a source's rate is its target by its size: documents without words come as often as its whole part
        sizes = {}
        for (_, text, _, source), n in before.items():
            sizes[source] = sizes.get(source, 0) + n * len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        rates = {s: int(t / sizes[s]) if sizes[s] else 0 for s, t in plain_targets(sizes).items()}
        assert all(got[k] == rates[k[3]] * n for k, n in before.items() if not (k[1] or "").strip())
        assert plain(STAGE[name](spark, docs, DATA).collect()) == got
    else:
        assert len(rows) == 12 and all(r.ids == [] and r.n_tokens == 0 for r in rows if r.doc_id in (2, 3)) and out.columns == ["doc_id", "lang", "source", "ids", "n_tokens"]


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_table(spark, name):
    docs = odd(spark).limit(0)
    out = STAGE[name](spark, docs, DATA)
    assert out.count() == 0 and (name == "BPE encoding" or out.columns == docs.columns)


def test_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in __spark_entry__.queries() if re.match(r"op\d+_", q)}
    assert "pipeline" in __spark_entry__.queries()
    assert simhash.SEED == 42
