"""Substring search by grams against every pair."""

import random

from pyspark.sql import functions as F

from unitgraph.functions import columns as C
from unitgraph.operators import retrieval as R
from unitgraph.operators import substring

WORDS = ["alph", "e_t", "a%m", "d\\e", "Q00", "q_1", "nothing", "x", "", "%", "_", "__%a", "é", "日本", "本", "GA%ma", "\\", "a.b", "[", "😀"]


def sources(spark):
    rng = random.Random(3)
    parts = ["Alpha", "be_ta", "ga%mma", "d\\elta", "x", "日本語", "é", "a.b[c", "😀q"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(80)] + [None, ""]
    units = spark.createDataFrame([(f"q{i:03d}", t, i) for i, t in enumerate(texts)] + [("q001", texts[1], 1)], "qualified_name string, summary string, word int")
    words = spark.createDataFrame([(q, w) for q in range(12) for w in rng.sample(WORDS, 3)] + [(90 + k, w) for k, w in enumerate(WORDS)] + [(None, "x"), (5, None), (0, "alph")], "query_id bigint, word string")
    return units, words


def every_pair(units, words):
    other = words.where("query_id is not null and word is not null").select("query_id", F.col("word").alias("_w"))
    found = units.crossJoin(other).where(C.contains_like(F.col("qualified_name"), F.col("_w")) | C.contains_like(F.coalesce("summary", F.lit("")), F.col("_w")))
    # a unit meets a query once, but equal units are units of their own
    best = {}
    for r in found.select(*units.columns, "query_id", "_w").collect():
        best.setdefault((tuple(r)[:-1], r._w), 0)
        best[tuple(r)[:-1], r._w] += 1
    rows = {}
    for (row, _), n in best.items():
        rows[row] = max(rows.get(row, 0), n)
    return sorted((row for row, n in rows.items() for _ in range(n)), key=repr)


def test_hits_are_all_pairs(spark):
    units, words = sources(spark)
    got = substring.hits(units, words, ["qualified_name", "summary"]).select(*units.columns, "query_id")
    want = every_pair(units, words.distinct())
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 300


def test_a_stored_index_gives_the_same(spark):
    units, words = sources(spark)
    rows = substring.folded_rows(units, ["qualified_name", "summary"])
    own = words.where("word is not null").select(C.ascii_fold(F.col("word")).alias("word")).distinct()
    index = substring.postings(rows, "_key", ["_f0", "_f1"])
    pairs = lambda **more: sorted(map(tuple, substring.matches(rows, own, "_key", ["_f0", "_f1"], **more).collect()))
    assert pairs() == pairs(index=index)


def test_both_ways_of_keyword_hits_agree(spark, monkeypatch):
    units, words = sources(spark)
    units = units.dropDuplicates(["qualified_name"])
    small = sorted(map(tuple, R.keyword_hits(units, words, 7).collect()), key=repr)
    monkeypatch.setattr(R, "WORD_BATCH", 2)
    assert sorted(map(tuple, R.keyword_hits(units, words, 7).collect()), key=repr) == small and small
    assert R.keyword_hits(units, words.limit(0)).count() == 0


def test_typed_batches(spark):
    units = spark.createDataFrame([(f"p.C#m{i:02d}", f"m{i:02d}") for i in range(60)], "qualified_name string, name string")
    typed = spark.createDataFrame([(1, " M0 "), (2, "\t "), (3, "c#m"), (4, None), (5, "m_9"), (6, "zz")], "query_id int, typed string")
    got = {}
    for r in substring.first_hits(units, typed, 99).collect():
        got.setdefault(r.query_id, []).append((r.place, r.name))
    one = lambda text: [(k + 1, r.name) for k, r in enumerate(R.autocomplete(units, text, 99).collect())]
    assert {k: sorted(v) for k, v in got.items()} == {1: one("M0"), 3: one("c#m"), 5: one("m_9")}
    assert substring.first_hits(units.limit(0), typed).count() == 0


def test_first_hits_of_each_word(spark, monkeypatch):
    """By one scan and by growing shares of the rows, with words of letters and others, the first units are those of every pair."""
    units, words = sources(spark)
    units = units.dropDuplicates(["qualified_name"]).select("qualified_name", "summary")
    words = words.union(spark.createDataFrame([(70, "alpha"), (71, "pha"), (71, "x\n"), (72, "ALPHAbe")], "query_id bigint, word string"))
    want = {}
    for name, _, query in every_pair(units, words.distinct()):
        want.setdefault(query, []).append(name)
    want = sorted((q, k + 1, n) for q, names in want.items() for k, n in enumerate(sorted(names)[:5]))
    for scan, shares in ((256, (0.5,)), (0, (1 / 64, 1 / 8)), (0, ()), (0, (0.1, 0.4, 0.9))):
        monkeypatch.setattr(substring, "SCAN", scan)
        monkeypatch.setattr(substring, "SHARES", shares)
        got = substring.first_by_query(units, words, ["qualified_name", "summary"], ["qualified_name"], 5)
        assert sorted((r.query_id, r.place, r.qualified_name) for r in got.collect()) == want


def test_a_crowd_of_equal_queries_shares_the_work(spark):
    """Rows behind the matching don't grow with queries times hits."""
    units = spark.range(400).select(F.lit("large ring").alias("name"), F.concat(F.lit("part."), F.col("id").cast("string")).alias("qualified_name"))
    found = substring.first_matches(substring.folded_rows(units, ["name"]), spark.createDataFrame([("ring",)], "word string"), "_key", ["_f0"], ["_f0"], 3)
    assert found.count() == 3
    typed = spark.range(500).select(F.col("id").alias("query_id"), F.lit(" RING ").alias("typed"))
    got = substring.first_hits(units, typed, 3)
    assert got.count() == 1500 and sorted({r.qualified_name for r in got.collect()}) == ["part.0", "part.1", "part.10"]


def test_a_list_too_long_to_broadcast(spark, monkeypatch):
    from unitgraph.plans import lineage

    monkeypatch.setattr(lineage, "SMALL", 10)
    names = spark.range(0, 1000, 3).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("callee"))
    table = spark.range(3000).select(F.concat(F.lit("n"), (F.col("id") % 1500).cast("string")).alias("callee"), "id").groupBy("callee").agg(F.count("*").alias("n"))
    assert lineage.maybe_named(table, "callee", names).count() < 350
    got = lineage.only_named(table, "callee", names).collect()
    assert sorted(r.callee for r in got) == sorted(r.callee for r in names.collect()) and {r.n for r in got} == {2}
