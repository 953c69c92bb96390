"""Events for any number of listeners (K8, ST5): a stream sink whose frames are seen once a batch is committed, and never twice.

``df.writeStream.format("event_frames").option("path", folder)`` takes one string column, the
events' data. Tasks write files that nobody reads; the commit of a batch names them in a small file,
with the number of the first event in each, and an aborted batch leaves nothing. A listener keeps
the number of the last event that it saw and goes on from there, late or again.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    file: str
    count: int


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].removeprefix("file://").rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(f"{self.folder}/data", exist_ok=True)
        name, count = f"{uuid.uuid4().hex}.json", 0
        with open(f"{self.folder}/data/{name}", "w", encoding="utf-8") as f:
            for count, row in enumerate(iterator, 1):
                f.write(json.dumps({"place": count - 1, "data": row[0]}, ensure_ascii=False) + "\n")
        return Written(name, count)

    def _drop(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.remove(f"{self.folder}/data/{m.file}")

    def commit(self, messages: list, batchId: int) -> None:
        os.makedirs(f"{self.folder}/batches", exist_ok=True)
        target = f"{self.folder}/batches/{batchId:012d}.json"
        if os.path.exists(target):  # the batch ran again after its commit
            self._drop(messages)
            return
        before = _batches(self.folder)
        at = before[-1]["next"] if before else 1
        files = []
        for m in messages:
            if m is not None and m.count:
                files.append({"file": m.file, "first": at, "count": m.count})
                at += m.count
        self._drop([m for m in messages if m is not None and not m.count])
        with open(target + ".tmp", "w", encoding="utf-8") as f:
            json.dump({"files": files, "next": at}, f)
        os.replace(target + ".tmp", target)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class EventFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("event_frames takes one string column")
        return FrameWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFrames)


def _batches(folder: str) -> list[dict]:
    home = f"{folder}/batches"
    names = sorted(n for n in os.listdir(home) if n.endswith(".json")) if os.path.isdir(home) else []
    found = []
    for n in names:
        with open(f"{home}/{n}", encoding="utf-8") as f:
            found.append(json.load(f))
    return found


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``seq, data`` of all committed events."""
    folder = folder.removeprefix("file://").rstrip("/")
    files = [f for b in _batches(folder) for f in b["files"]]
    if not files:
        return spark.createDataFrame([], "seq bigint, data string")
    firsts = spark.createDataFrame([(f["file"], f["first"]) for f in files], "file string, first bigint")
    rows = spark.read.schema("place bigint, data string").json([f"file://{folder}/data/{f['file']}" for f in files])
    named = rows.withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/", -1))
    return named.join(firsts, "file").select((F.col("first") + F.col("place")).alias("seq"), "data")


def replay(folder: str, after: int = 0) -> Iterator[tuple[int, str]]:
    """``seq, frame`` of the committed events behind number ``after``, in order; files before it aren't opened."""
    folder = folder.removeprefix("file://").rstrip("/")
    for batch in _batches(folder):
        for own in batch["files"]:
            if own["first"] + own["count"] <= after + 1:
                continue
            with open(f"{folder}/data/{own['file']}", encoding="utf-8") as f:
                for line in f:
                    row = json.loads(line)
                    seq = own["first"] + row["place"]
                    if seq > after:
                        lines = "".join(f"data: {x}\n" for x in (row["data"] or "").split("\n"))
                        yield seq, f"id: {seq}\n{lines}\n"


def follow(folder: str, after: int = 0, heartbeat: float = 15.0, poll: float = 0.5, until: float | None = None) -> Iterator[str]:
    """Frames behind ``after`` as they are committed, and a heartbeat comment where none came for so many seconds; ends after ``until`` seconds, if given."""
    began = quiet = time.monotonic()
    while until is None or time.monotonic() - began < until:
        for seq, frame in replay(folder, after):
            after, quiet = seq, time.monotonic()
            yield frame
        if time.monotonic() - quiet >= heartbeat:
            quiet = time.monotonic()
            yield ": heartbeat\n\n"
        time.sleep(poll)
