import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitgraph.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@given(st.one_of(st.text(max_size=80), st.text(alphabet="aeiou th'sé\n\t<|endoftext|>0159!?", max_size=200), st.text(alphabet="ab", max_size=300), st.text(alphabet="a  \n\t\u00a0.'s", max_size=30), st.text(alphabet=" \x1c\x85 ​՘ x", max_size=20)))
@settings(max_examples=1500, deadline=None)
def test_like_the_library(text):
    from tokenizers import Tokenizer

    global _LIB
    try:
        lib = _LIB
    except NameError:
        lib = _LIB = Tokenizer.from_file(PATH)
    coder = bpe.load(PATH)
    ids = coder.encode(text)
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert bpe.load(PATH, bpe.Decoder).decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_long_pieces(library):
    coder = bpe.load(PATH)
    for text in ("a" * 5000, "abcde" * 3000, "é" * 2000, " " * 3000 + "x", "<|endoftext|>" * 3 + "<|endof", "the quick brown fox " * 2000, "0123456789" * 500):
        ids = coder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.load(PATH, bpe.Decoder).decode(ids) == text


def test_any_ids(library):
    coder = bpe.load(PATH, bpe.Decoder)
    for ids in ([], [50256, 0, 255], [188, 189, 190, 5], [128, 129, 250, 11], list(range(0, 50257, 97))):
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_letters_of_all_planes(library):
    coder = bpe.load(PATH)
    for start in range(0, 0x110000, 0x800):
        text = "".join("a" + chr(c) + "1 " for c in range(start, start + 0x800, 7) if not 0xD800 <= c < 0xE000)
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    for c in [*range(0x530), *range(0x2010, 0x2071), *range(0x20A0, 0x20B1), *range(0x3041, 0x30FB), *range(0x4E00, 0x9FA6, 50), *range(0xAC00, 0xD7A4, 50)]:
        text = f"a{chr(c)}b {chr(c)} "
        if coder.common.fullmatch(text):
            assert coder.pieces(text) == [text[a:b] for _, (a, b) in coder.pre_tokenizer.pre_tokenize_str(text)]


def test_many_texts(library):
    import duckdb

    texts = [r[0] for r in duckdb.execute("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    offsets, flat = bpe.load(PATH).encode_batch(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_digests(spark, library):
    rows = [(1, "Hello wörld <|endoftext|> again", "x"), (None, None, "y"), (2, "", "z"), (2, "", "z"), (3, "long " * 40000, "l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), PATH).count() == 0


@given(st.lists(st.text(alphabet="ab é\n1.'一，ы\"|<>", max_size=120), max_size=6), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_parts_of_long_texts(texts, most):
    coder = bpe.load(PATH)
    joined, ids = [""] * len(texts), [[] for _ in texts]
    for numbers, group in bpe.parts(texts, most):
        for k, part in zip(numbers, group):
            joined[k] += part
            ids[k] += coder.encode(part)
    assert joined == texts and ids == [coder.encode(t) for t in texts]


def test_texts_without_spaces_are_cut():
    rng = __import__("random").Random(4)
    text = "".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.randint(1, 12))) + rng.choice("，。！\n") for _ in range(3000))
    cut = [part for _, group in bpe.parts([text], 900) for part in group]
    assert "".join(cut) == text and max(map(len, cut)) <= 300 + 13
    coder = bpe.load(PATH)
    assert sum((coder.encode(p) for p in cut), []) == coder.encode(text)
    # a mark that a special token holds is no border
    assert not bpe.borders(["<a.b>"]).search("a.b") and bpe.borders(["<a>"]).search("a.b").start() == 1


@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12, unique=True), st.binary(max_size=30).map(lambda b: bytes(x % 4 for x in b)))
@settings(max_examples=300, deadline=None)
def test_suffix_automaton(words, text):
    """Walking a text gives the words that end at each place, longest first."""
    machine = bpe.SuffixAutomaton(dict(enumerate(words)))
    state, length = 0, 0
    for end in range(1, len(text) + 1):
        while (to := machine.step.get(state << 8 | text[end - 1])) is None and state:
            state = machine.link[state]
            length = machine.length[state]
        state, length = (0, 0) if to is None else (to, length + 1)
        at, found = state if machine.word[state] >= 0 and machine.length[state] == length else machine.shorter[state], []
        while at >= 0:
            found.append(words[machine.word[at]])
            at = machine.shorter[at]
        assert found == sorted((w for w in words if text[:end].endswith(w)), key=len, reverse=True)


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BYTES", 20_000)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    with open(PATH, encoding="utf-8") as f:
        coder = bpe.BytePairs(f.read())
    texts = [" ".join(f"w{i}x{i * i}" for i in range(at, at + 300)) for at in range(0, 3000, 300)]
    for text in texts:
        assert coder.encode_batch([text])[1].tolist() == bpe.load(PATH).encode(text)
    assert len(coder.table) + len(coder.old_table) < 400 and len(coder.pairs) <= 50
