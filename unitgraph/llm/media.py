"""Media columns: interleaved document sequences over a store of payloads.

* :func:`sequences` parses HTML into an ordered array of structs: runs of text, and
  references to media (digest and caption) where they stand.
* A *store* is a Parquet table in the shared folder with a row for each stored payload:
  digest of the payload, and a lossless image of its bytes - an 8-bit grey PNG of
  ``WIDTH`` samples a row. A writing task stores a payload once, however many rows hold it.
* :func:`resolve` joins references to the store by digest. Positions and captions stay
  with their reference; payload columns are read only if asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path

WIDTH = 576
FILL = b"\xff"
SLICE = 4 << 20
SEGMENT = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"
SCHEME = "sha256:"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey PNG whose samples, row by row, are the payload (its length a positive multiple of ``WIDTH``)."""
    height, rest = divmod(len(payload), WIDTH)
    if rest or not height:
        raise ValueError(f"{len(payload)} bytes aren't rows of {WIDTH}")
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The payload of :func:`to_png`; raises if a checksum or the form is wrong."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, header = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if header is None or header[0] != WIDTH or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not this module's form of PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(header[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    return text + FILL * (WIDTH - len(text) % WIDTH if not text or len(text) % WIDTH else 0)


def describe(samples: bytes) -> str:
    """Features of an image: rows, mean and deviation, entropy in bits, and a 64-bit hash of where columns are above their mean."""
    a = np.frombuffer(samples, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    used = share[share > 0]
    columns = a.reshape(-1, 64, WIDTH // 64).mean(axis=(0, 2))
    bits = np.packbits((columns > columns.mean()).astype(np.uint8)).tobytes().hex()
    return f"rows={len(a) // WIDTH};mean={a.mean():.4f};std={a.std():.4f};entropy={-(used * np.log2(used)).sum():.4f};hash={bits}"


class _Sequence(HTMLParser):
    """Text runs and images in page order; a figure's caption goes to its images, else their alt text is it."""

    SKIP, BLOCKS = {"script", "style", "head", "template", "noscript"}, {"p", "div", "figure", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "tr", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.skipped, self.figures, self.caption = [], [], None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped.append(tag)
        if self.skipped:
            return
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            self.flush()
            own = dict(attrs)
            src = own.get("src") or ""
            segment = {"kind": "media", "text": None, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": own.get("alt") or own.get("title")}
            self.out.append(segment)
            if self.figures:
                self.figures[-1].append(segment)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for segment in self.figures[-1] if self.figures else []:
                segment["caption"] = words or segment["caption"]
            self.caption = None
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data):
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"pos": i} | s for i, s in enumerate(parser.out)]


def sequences(pages: DataFrame, html_col: str = "html", out_col: str = "segments") -> DataFrame:
    """``pages`` with ``out_col`` (array of pos, kind, text, digest, caption) in place of ``html_col``; empty for null or empty html."""
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    kinds = dict(pages.dtypes)
    fields = pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))])

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 1
            made = pa.array([sequence(h.as_py()) for h in batch.column(n)], pa.list_(fields))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], [*kept, out_col])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{out_col}` array<{SEGMENT}>"])
    return pages.select(*kept, html_col).mapInArrow(run, schema)


def write_store(payloads: DataFrame, text_col: str = "text", path: str | None = None, level: int = 3) -> str:
    """Store the padded UTF-8 bytes of each value of ``text_col`` (null: empty) as PNG; returns the table's path.

    Columns: ``digest`` (SHA-256 of the payload), ``data``. Each task leaves out
    payloads it has stored already; other tasks may store them again.
    """
    spark = payloads.sparkSession

    def run(batches):
        stored = set()
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                digests, images = [], []
                for value in whole.column(0).slice(at, rows):
                    payload = padded(value.as_py() or b"")
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in stored:
                        stored.add(digest.digest())
                        digests.append(digest.hexdigest())
                        images.append(to_png(payload, level))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["digest", "data"])

    path = path or new_path(spark, "media-store")
    payloads.select(F.col(text_col).cast("binary")).mapInArrow(run, "digest string, data binary").write.option("compression", "none").parquet(path)
    return path


FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each digest of a store, computed from the bytes read back. Raises if they don't have that digest."""

    def run(batches):
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column(0), batch.column(1)):
                stored = data.as_py()
                payload = from_png(stored)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest.as_py():
                    raise ValueError(f"payload {digest} was read back as {found}")
                rows.append((found, len(payload), found, zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
            kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in FEATURES.split(", ")])

    table = spark.read.schema("digest string, data binary").parquet(path).mapInArrow(run, FEATURES)
    first = F.first(F.struct(*table.columns[1:])).alias("f")  # copies of a digest are equal
    return table.groupBy("digest").agg(first).select("digest", "f.*")


def references(pages: DataFrame, segments_col: str = "segments") -> DataFrame:
    """One row for each media reference, with the page's other columns, ``pos``, ``digest`` and ``caption``."""
    kept = [c for c in pages.columns if c not in (segments_col, "pos", "digest", "caption")]
    return pages.select(*kept, F.explode(segments_col).alias("_s")).where("_s.kind = 'media'").select(*kept, "_s.pos", "_s.digest", "_s.caption")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """``refs`` with the columns of ``store`` (one row a digest); references that the store doesn't have keep nulls."""
    return refs.join(store, "digest", "left")


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as an image of an interleaved document: stored, referenced, resolved.

    Returns ``id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pos, caption``. Null is the empty text; rows with null or
    repeated ids each keep their own row; equal texts get equal values.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("bigint"))
    fill = F.when(F.col("n_bytes") == 0, WIDTH).otherwise(F.pmod(-F.col("n_bytes"), F.lit(WIDTH))).cast("int")
    digest = F.sha2(F.concat("raw", F.expr("unhex(repeat('FF', _fill))")), 256)
    html = F.concat(F.lit("<article><p>text of "), F.col("n_bytes"), F.lit(' bytes</p><figure><img src="' + SCHEME), digest, F.lit('"><figcaption>'), F.col("n_bytes"), F.lit(" bytes</figcaption></figure></article>"))
    pages = rows.withColumn("_fill", fill).select("id", "n_bytes", html.alias("html"))
    # written, so that the join below stands alone and a hot digest's references can be split
    store = materialize(read_features(docs.sparkSession, write_store(docs.select(F.col(text_col).alias("text")), "text")), "media-features")
    found = resolve(references(sequences(pages)), store)
    return found.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
