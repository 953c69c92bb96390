"""Fill-in-middle against a plain version, its round trip, and its SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from unitgraph.llm import fim, queries

DATA = "/root/testdata/sf0.001"
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text, rate=100, spm=50, unit=LINE, seed=7):
    text = text or ""
    digest = sha(f"{seed}:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    pieces = unit.findall(text)
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "\na", "x<P>y\nz", "<S>", "a<", "<P", "a\r\nb c\nd", "é😀\n𝒳\n\n", "P>\n<S\n>M", " \n\t\n", "z" * 300_000, "line\n" * 50_000]
    texts += ["".join(rng.choice("ab\n<>PSM😀é ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return texts


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(None, "a\nb\nc"), (3, "a\nb"), (3, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, fim.digests(docs).collect()), key=repr)
    assert got == sorted((plain_version(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("unit,pattern", [("character", r"[\s\S]"), ("word", r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("token", r"\w+|[^\w]+")])
def test_other_units(spark, unit, pattern):
    own = re.compile(pattern, re.ASCII)
    rows = [(k, t) for k, t in enumerate(odd_texts()) if t is None or len(t) < 1000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, fim.digests(docs, unit=unit, rate=70, spm=20, seed=11).collect()))
    assert got == sorted(plain_version(*r, rate=70, spm=20, unit=own, seed=11) for r in rows)


def test_pieces_join_to_the_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc", 9, "x")], "doc_id bigint, text string, n int, form string")
    row = fim.restore(fim.transform(docs)).first()
    assert row.prefix + row.middle + row.suffix == row.restored == "a\nb\n\nc" and row.n == 4


def test_empty_table_and_other_names(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    docs = spark.createDataFrame([("k", "a\nb")], "`my id` string, `my text` string")
    assert fim.digests(docs, id_col="my id", text_col="my text").first().restored_sha256 == sha("a\nb")


def test_marks_that_overlap_are_refused():
    for own in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "b", "c"), ("xay", "a", "c")):
        with pytest.raises(ValueError):
            fim.Sentinels(*own)


def test_whole_table_and_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op11_fim(spark, DATA)
    found = duck.execute(queries.oracle_sql()["op11_fim"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert want == sorted(plain_version(*r) for r in texts)
