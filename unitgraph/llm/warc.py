"""WARC archives: a distributed writer and a sequential reader.

Writer: each task writes gzip archives with one member for each record, rolls them
at ``roll_bytes``, and moves each to its final name only when it is whole, so a lost
or repeated task leaves no half archive. Of records with equal payloads the one with
the smallest id is a ``response``; the others are ``revisit`` records that carry the
response's HTTP header, not its payload.

Reader: one pass from front to back with bounded memory. Members are inflated
incrementally, a block ends where its Content-Length says, and the block and payload
digests are computed again and compared.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, qualified

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids are UUIDs whose lower half is the page id; the upper half tells these (and rows without an id) apart.
PREFIX, PREFIX_NONE = 0x756E69746772, 0x6E6F69646772


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, ordinal: int = 0) -> str:
    low = ordinal if page_id is None else page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(PREFIX_NONE if page_id is None else PREFIX) << 80 | low)}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id that :func:`record_id` made; None for any other."""
    if not record or not record.startswith("<urn:uuid:"):
        return None
    value = uuid.UUID(record[10:-1]).int
    if value >> 80 != PREFIX:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, ordinal: int = 0) -> bytes:
    """One record, not compressed; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, ordinal)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class Members:
    """Reads a concatenation of gzip members: bytes of the current member, then :meth:`next_member`."""

    def __init__(self, stream):
        self.stream, self.raw, self.ready = stream, b"", bytearray()
        self.inflate, self.offset = None, 0

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if self.inflate is not None and (self.ready or not self.inflate.eof and self._more()):
            raise ValueError("a member holds more than one record")
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Inflate up to one chunk into ``ready``; False at the member's end."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise EOFError("an archive ends within a member")
            before = len(self.raw)
            out = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.offset += before - len(self.raw)
            if out:
                self.ready += out
                return True
        return False

    def until(self, end: bytes) -> bytes:
        """All up to ``end``, however long: a header is as long as the longest URL."""
        looked = 0
        while (at := self.ready.find(end, looked)) < 0:
            looked = max(0, len(self.ready) - len(end) + 1)
            if not self._more():
                raise ValueError("a header has no end")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(end)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise EOFError("a block is shorter than its Content-Length")
            part = bytes(self.ready[:n])
            del self.ready[: len(part)]
            n -= len(part)
            yield part


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """Records of one archive, in order. Raises if a frame or a digest is wrong."""
    members = Members(stream)
    while True:
        offset = members.offset
        if not members.next_member():
            return
        version, *lines = members.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {offset}")
        head = _fields(lines)
        block, payload, length, kept, http = hashlib.sha1(), hashlib.sha1(), 0, [], b""
        in_header = head.get("content-type", "").startswith("application/http")
        for part in members.exactly(int(head["content-length"])):
            block.update(part)
            if in_header:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, part, in_header = http[:at], http[at + 4 :], False
            payload.update(part)
            length += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(members.exactly(4)) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {offset} doesn't end with an empty line")
        if head.get("warc-block-digest", block_digest := "sha1:" + base64.b32encode(block.digest()).decode()) != block_digest:
            raise ValueError(f"block digest of the record at byte {offset}")
        kind = head["warc-type"]
        found = "sha1:" + base64.b32encode(payload.digest()).decode()
        said = head.get("warc-payload-digest", found)
        if kind == "response" and said != found:
            raise ValueError(f"payload digest of the record at byte {offset}")
        if kind == "revisit":
            length = int(_fields(http.decode("latin-1").split("\r\n")[1:])["content-length"])
        yield {
            "record_id": head["warc-record-id"], "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to_id": head.get("warc-refers-to"),
            "payload": b"".join(kept) if with_payload and kind != "revisit" else None, "payload_bytes": length, "payload_digest": said.removeprefix("sha1:"), "offset": offset,
        }


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: which rows revisit the payload of which other row.

    Only digests that occur more than once are joined back; that table's size decides
    how (Spark broadcasts it below its threshold, else joins by digest and splits hot ones).
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_enough = F.length("payload") >= revisit_bytes
    repeated = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeated = materialize(repeated.select("digest", "first"), "repeated-payloads")
    revisits = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", F.when(revisits, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 4) -> DataFrame:
    """Write ``page_id, url, payload, refers_to`` rows to ``folder`` (a URI of the shared store); returns ``archive, records, bytes``.

    A folder without a scheme is one of Spark's default file system.
    """
    folder = qualified(rows.sparkSession, folder)

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, done, n, size, ordinal = None, [], 0, 0, 0

        def close():
            out.close()
            name = f"part-{part:06d}-{len(done):05d}.warc.gz"
            store.move(f"{root}/{temporary}", f"{root}/{name}")
            done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c for c in batch.columns)):
                if out is None:
                    temporary = f".{part:06d}-{len(done):05d}-{attempt}"
                    out, n, size = store.open_output_stream(f"{root}/{temporary}", compression=None), 0, 0
                data = member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), part << 40 | ordinal), level)
                ordinal += 1
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "warc-manifest")


SCHEMA = "archive string, offset bigint, record_id string, page_id bigint, record_type string, target_uri string, refers_to_id string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives named in column ``archive``; each archive is read by one task, from front to back."""

    def run(batches):
        names = [x.strip() for x in SCHEMA.split(",")]
        fields = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in names])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        rows.append(r | {"archive": path, "page_id": page_of(r["record_id"]), "refers_to": page_of(r["refers_to_id"])})
                        held += 500 + len(r["payload"] or b"")
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    n = max(1, min(archives.count(), 100_000))
    return archives.select("archive").repartition(n).mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Write one record for each row of ``pages`` to the shared folder, then read all back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, archive``.
    Null html is an empty payload; a null url leaves the target URI out; rows with a null
    id are written too and revisit like others, but no record refers to one. Rows that
    share the smallest id of their payload are all responses.
    """
    spark = pages.sparkSession
    manifest = write_archives(classify(pages, id_col, url_col, html_col, revisit_bytes), new_path(spark, "warc"))
    return read_archives(spark, manifest, with_payload=False).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"
    )
