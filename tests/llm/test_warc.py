import base64
import gzip
import hashlib
import io

import pytest

from unitgraph.llm import warc


def archive(*records):
    return io.BytesIO(b"".join(warc.member(r) for r in records))


def test_sequential_reader():
    big = bytes(range(256)) * 2000
    made = [warc.record(1, "http://a/", b"one", None), warc.record(-2, None, big, None), warc.record(3, "http://b/ c\r\n", b"one", 1), warc.record(4, "u", b"", None)]
    got = list(warc.read_records(archive(*made)))
    assert [(warc.page_of(r["record_id"]), r["record_type"], r["payload"], r["payload_bytes"], warc.page_of(r["refers_to_id"])) for r in got] == [(1, "response", b"one", 3, None), (-2, "response", big, len(big), None), (3, "revisit", None, 3, 1), (4, "response", b"", 0, None)]
    assert got[2]["target_uri"] == "http://b/%20c%0D%0A"
    data = archive(*made).getvalue()
    assert gzip.decompress(data) == b"".join(made)
    assert [gzip.GzipFile(fileobj=io.BytesIO(data[r["offset"] :])).read(8) for r in got] == [b"WARC/1.1"] * 4


def test_damage_is_seen():
    whole = warc.record(1, "http://a/", b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(archive(whole.replace(b"payload", b"paYload"))))
    with pytest.raises(ValueError):
        list(warc.read_records(archive(whole + whole)))
    with pytest.raises(ValueError):
        list(warc.read_records(archive(whole.replace(b"WARC/1.1", b"WORC/1.1"))))
    with pytest.raises((EOFError, ValueError)):
        list(warc.read_records(io.BytesIO(archive(whole).getvalue()[:-20])))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_round_trip(spark):
    same = "<p>é same</p>"
    rows = [(9, "http://x/9", same), (4, "http://x/4", same), (6, None, same), (4, "http://x/4b", same), (None, "n", same), (1, "u", None), (2, "u", ""), (3, "u", "z" * 300000), (None, None, "only"), (-5, "neg", "neg")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = warc.round_trip(df.withColumn("archive", warc.F.lit(1)).withColumn("digest", warc.F.lit("x")))
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    first = {same: 4, "": 1}
    want = []
    for i, _, h in rows:
        h = h or ""
        f = first.get(h)
        again = f is not None and (i is None or i > f)
        want.append((i, len(h.encode()), digest(h), "revisit" if again else "response", f if again else None))
    got = [tuple(r)[:5] for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = warc.round_trip(df, revisit_bytes=10).where("payload_bytes < 10")
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_rolling_and_payloads(spark):
    rows = spark.range(50).selectExpr("id as page_id", "concat('http://h/', id) as url", "encode(repeat(cast(id as string), 4000), 'UTF-8') as payload", "cast(null as bigint) as refers_to")
    manifest = warc.write_archives(rows.coalesce(1), warc.new_path(spark, "warc-test"), roll_bytes=500)
    assert manifest.count() > 5
    back = warc.read_archives(spark, manifest)
    assert back.count() == 50
    assert back.join(rows, "page_id").where(back.payload == rows.payload).count() == 50


def test_a_header_may_be_long(spark):
    url = "http://a.example/" + "x" * 1_300_000
    made = [warc.record(1, url, b"one", None), warc.record(2, "u", b"two", None)]
    assert [(r["target_uri"], r["payload"]) for r in warc.read_records(archive(*made))] == [(url, b"one"), ("u", b"two")]
    rows = spark.createDataFrame([(1, url, "<p>x"), (2, "http://b/", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(rows).collect()) == [(1, "response", None), (2, "revisit", 1)]


def test_folders_without_a_scheme(spark, tmp_path):
    from unitgraph.llm.shared import qualified

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == qualified(spark, f"file://{tmp_path}") == qualified(spark, f"file:{tmp_path}")
