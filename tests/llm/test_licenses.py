import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitgraph.llm import licenses as L

TEMPLATES = [L.Template(n, t) for n, t in L.TEMPLATES.items()]
words = st.lists(st.sampled_from("abcdefgh"), max_size=25)


def longest_increasing(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max([best[j] for j in range(i) if values[j] < v], default=0))
    return max(best, default=0)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_align(a, b):
    pairs = L.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    chain = L.anchors(a, b)
    unique = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    assert len(chain) == longest_increasing([j for _, j in unique]) and set(chain) <= set(unique)
    assert len(pairs) >= len(chain)
    assert L.align(a, a) == [(i, i) for i in range(len(a))]


def test_seeds_are_enough():
    for t in TEMPLATES:
        assert sum(len(at) for at in t.seeds.values()) > 0.2 * len(t.tokens)


def plain_scan(text, templates):
    """Best density-bounded alignment over every stretch of text, by brute force; whether each template is there."""
    tokens = L.words(text)
    found = set()
    for t in templates:
        size = len(t.tokens)
        for p in range(len(tokens)):
            pairs = L._densest(L.align(tokens[p : p + size * 5 // 4 + 2], t.tokens), size * 5 // 4 + 2)
            if len(pairs) >= 0.8 * size - 1e-9:
                found.add(t.name)
                break
    return found


def test_against_brute_force(spark):
    rng = random.Random(4)
    filler = "the of and software is license version this to in for on terms with code general you may public use".split()
    rows, names = [], list(L.TEMPLATES)
    for i in range(60):
        out = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.8:
            tokens = L.words(L.TEMPLATES[rng.choice(names)])
            for _ in range(int(len(tokens) * rng.choice([0, 0.05, 0.1, 0.4]))):
                tokens[rng.randrange(len(tokens))] = "changed" + str(rng.randrange(99))
            out += tokens
        out += [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in L.scan_licenses(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.coverage <= 1 and r.matched <= r.end_word - r.start_word
    for i, text in rows:
        want = plain_scan(text, TEMPLATES)
        assert got.get(i, set()) <= want
        # a short grant inside a longer notice gives way to it
        assert {w for w in want if not w.endswith("-short")} <= got.get(i, set()) and bool(want) == bool(got.get(i))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in L.scan_licenses(docs).collect()}
    want = {(r.doc_id, n) for r in docs.collect() for n, t in L.TEMPLATES.items() if n.endswith("-short") and " ".join(L.words(t)) in " ".join(L.words(r.text))}
    assert want and want <= got


def test_edges(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, mit + "\n" + mit), (3, mit), (None, "x " * 100000 + L.TEMPLATES["MIT-short"]), (4, "license " * 3000), (5, "LICENSED under\nCC   BY-NC 4.0!")]
    df = spark.createDataFrame([(i, t, "k", 1.0) for i, t in rows], "doc_id bigint, text string, license string, coverage double")
    got = sorted((r.doc_id or 0, r.license, r.coverage, r.start_word) for r in L.scan_licenses(df).collect())
    size = len(L.words(mit))
    assert got == sorted([(3, "MIT", 1.0, 0), (3, "MIT", 1.0, 0), (3, "MIT", 1.0, size), (0, "MIT-short", 1.0, 100000), (5, "CC-BY-NC-4.0-short", 1.0, 0)])
    assert L.scan_licenses(df.limit(0)).count() == 0


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_common_subsequence(a, b):
    pairs = L._common_subsequence(a, b)
    assert len(pairs) == plain_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_repeated_words_of_any_number():
    """A list that differs in its first and last word only, of words that all repeat, on both sides of 4,096 cells."""
    for n in (20, 60, 64, 65, 70, 200):
        inner = [f"w{i % 8}" for i in range(n)]
        assert len(L.align(["first", *inner, "last"], ["other", *inner, "end"])) == n
        shifted = ["first", *inner[: n // 2], "x", *inner[n // 2 :], "last"]
        assert len(L.align(shifted, ["other", *inner, "end"])) >= n - 8


def test_template_of_repeated_words():
    body = " ".join(f"w{i % 8}" for i in range(160))
    template = L.Template("loop", f"begin {body} finish")
    found = L.scan(f"some words before {body} and some behind", [template])
    assert [m.license for m in found] == ["loop"] and found[0].matched >= 0.8 * 162


LONG = [n for n, t in L.TEMPLATES.items() if len(L.words(t)) >= 60]


def foreign(rng, n):
    return ["".join(rng.choice("bcdfgklmnpqrstvwxz") for _ in range(7)) for _ in range(n)]


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize("inserted", [0.5, 1, 20])
@pytest.mark.parametrize("places", [1, 2])
def test_insertions_of_any_length(name, inserted, places):
    rng = random.Random(len(name) * places)
    template = L.Template(name, L.TEMPLATES[name])
    size, found = len(template.tokens), 0
    for _ in range(10):
        text = list(template.tokens)
        for at in sorted(rng.sample(range(8, size - 8), places), reverse=True):
            text[at:at] = foreign(rng, int(size * inserted))
        before = foreign(rng, 50)
        match = [m for m in L.scan(" ".join([*before, *text, *foreign(rng, 50)]), [template]) if m.license == name]
        # an insertion near an end leaves a match of the rest, within the template's length
        found += len(match) == 1 and match[0].coverage >= 0.8 and 50 <= match[0].start_word < match[0].end_word <= 50 + len(text)
    assert found >= 9


def test_words_of_a_license_scattered_in_a_text_are_none():
    rng = random.Random(3)
    for name in LONG:
        template = L.Template(name, L.TEMPLATES[name])
        scattered = [x for w in template.tokens for x in (w, *foreign(rng, 3))]
        assert L.scan(" ".join(scattered), [template]) == []
        # half of it isn't enough, wherever the rest is
        half = template.tokens[: len(template.tokens) // 2]
        assert L.scan(" ".join([*half, *foreign(rng, 500), *half]), [template]) == []


def test_many_openings_take_little_time():
    template = L.Template(LONG[0], L.TEMPLATES[LONG[0]])
    text = (template.tokens[: len(template.tokens) // 3] + ["foreign"] * 20) * 400
    began = time.time()
    assert L.scan(" ".join(text), [template]) == []
    assert time.time() - began < 60
