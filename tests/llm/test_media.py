import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitgraph.llm import media


@given(st.binary(max_size=3000))
@settings(max_examples=80, deadline=None)
def test_png_is_lossless(text):
    payload = media.padded(text)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(text) and set(payload[len(text) :]) <= {255}
    assert len(payload) - len(text) < 576 or not text
    assert media.from_png(media.to_png(payload)) == payload


def test_damaged_png():
    data = bytearray(media.to_png(b"\x07" * 576))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(data))


def test_sequence_keeps_order_and_captions():
    html = """<head><title>t</title></head><p>One &amp; two</p><figure><img src="sha256:aa" alt="old"><img src="sha256:bb"><figcaption>Both <b>of</b>
    them</figcaption></figure>tail<script>var x="<img src='sha256:zz'>"</script><img src="http://x/y.png" title="far"><p>end"""
    got = [(s["pos"], s["kind"], s["text"], s["digest"], s["caption"]) for s in media.sequence(html)]
    assert got == [(0, "text", "One & two", None, None), (1, "media", None, "aa", "Both of them"), (2, "media", None, "bb", "Both of them"), (3, "text", "tail", None, None), (4, "media", None, None, "far"), (5, "text", "end", None, None)]
    assert media.sequence(None) == media.sequence("") == []


def test_resolve_general(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:d1" alt="x"><img src="sha256:none">', "k"), (2, None, "k"), (3, '<img src="sha256:d1">' * 3, "k")], "page_id long, html string, caption string")
    store = spark.createDataFrame([("d1", b"12")], "digest string, data binary")
    got = media.resolve(media.references(media.sequences(pages)), store).collect()
    assert sorted((r.page_id, r.pos, r.caption, bytes(r.data) if r.data else None) for r in got) == [(1, 1, "x", b"12"), (1, 2, None, None)] + [(3, i, None, b"12") for i in range(3)]


def test_text_images(spark):
    texts = [(1, "héllo"), (2, None), (3, ""), (None, "héllo"), (4, "x" * 576), (5, "y" * 577), (6, "long é" * 50000), (6, "twice"), (6, "twice")]
    df = spark.createDataFrame([(*t, "c", 1) for t in texts], "doc_id bigint, text string, digest string, n_bytes int")
    got = media.text_images(df).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, []).append(r)
    for _, text in texts:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = media.to_png(payload)
        for r in by[hashlib.sha256(payload).hexdigest()]:
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.describe(payload))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts)
    assert media.text_images(df.limit(0)).count() == 0
