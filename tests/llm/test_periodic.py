"""Runs of words against all runs by definition, odd texts, linear time, and the whole table."""

import hashlib
import random
import re
import time
import zlib

import pytest

from unitgraph.llm import periodic, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, min_length=6, min_exponent=4):
    """Every maximal stretch of each period, smallest periods first: a stretch that a smaller period has too isn't of this one."""
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(min_length, min_exponent * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def row_of(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    letters, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randint(0, 60)
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (1, 2), (2, 2), (6, 3), (10, 2), (30, 4)])
def test_all_runs_of_random_words(min_length, min_exponent):
    rng = random.Random(min_length * 10 + min_exponent)
    for _ in range(250):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        assert periodic.find_runs(texts, min_length, min_exponent) == [all_runs(t, min_length, min_exponent) for t in texts]


def test_many_trees(monkeypatch):
    """Stretches that are dealt to several trees give the same runs."""
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(60)]
    want = [all_runs(t) for t in texts]
    for size in (1, 20, 100):
        monkeypatch.setattr(periodic, "TREE", size)
        assert periodic.find_runs(texts) == want


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return [c.encode() for c in b[:n]]


def test_known_words():
    word = fibonacci(400)
    assert periodic.find_runs([word], 2, 2)[0] == all_runs(word, 2, 2)
    assert periodic.find_runs([[b"x"] * 1000]) == [[(0, 1000, 1)]]
    assert periodic.find_runs([[b"x", b"y"] * 4 + [b"x"]]) == [[(0, 9, 2)]]
    assert periodic.find_runs([[], [b"x"] * 5, [b"x"] * 6]) == [[], [], [(0, 6, 1)]]
    # a run in a run
    word = ([b"a"] * 6 + [b"b"]) * 4
    assert periodic.find_runs([word])[0] == all_runs(word) and len(all_runs(word)) == 5


@pytest.mark.parametrize("kind", ["one", "two", "fibonacci", "long period", "few words"])
def test_time_is_nearly_linear(kind):
    def made(n):
        rng = random.Random(1)
        if kind == "one":
            return [b"a"] * n
        if kind == "two":
            return [b"a", b"b"] * (n // 2)
        if kind == "fibonacci":
            return fibonacci(n)
        if kind == "few words":
            return [rng.choice([b"a", b"b"]) for _ in range(n)]
        return [b"%d" % rng.randrange(500) for _ in range(n // 5)] * 5

    spent = []
    for n in (20_000, 80_000):
        words, began = made(n), time.time()
        periodic.find_runs([words])
        spent.append(time.time() - began)
    assert spent[1] < 8 * spent[0] + 0.5 and spent[1] < 8


def odd_rows():
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 3000), (5, "a b  c\x1cd " * 8), (6, "né ü " * 9), (None, "y " * 7), (7, "z z z z z z"), (7, "z z z z z z"), (8, "one")]
    rows += [(k, b" ".join(random_words(rng)).decode()) for k in range(100, 400)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, runs string, id int")
    got = sorted(map(tuple, periodic.digests(docs).collect()), key=repr)
    assert got == sorted((row_of(*r, plant=False) for r in rows), key=repr)
    got = sorted(map(tuple, periodic.digests(periodic.with_period(docs)).collect()), key=repr)
    assert got == sorted((row_of(*r) for r in rows), key=repr)


def test_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([("k", "p q " * 5 + "r")], "`my id` string, `my text` string")
    row = periodic.detect(docs, "my id", "my text").first()
    assert [tuple(r) for r in row.runs] == [(0, 10, 2)] and row.collapsed == "p q r" and row["my id"] == "k"
    assert periodic.digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    with pytest.raises(ValueError):
        periodic.detect(docs, "my id", "my text", min_exponent=1)


def test_whole_table(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((row_of(*r) for r in texts), key=repr)
    got = sorted(map(tuple, queries.op12_runs(spark, DATA).collect()), key=repr)
    assert got == want and sum(r[1] > 0 for r in want) > 10
