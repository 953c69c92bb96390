"""A source folder as a stream of events (SC11): created, modified and deleted files between two looks at the tree.

``spark.readStream.format("folder_events").option("path", tree).option("state", folder).load()``.
A look at the tree is a snapshot of (path, size, time of change), written to ``state``, a folder that driver and
executors share; an offset is a snapshot's number. Events are the difference of two
snapshots, so a batch that runs again, or a restarted stream, yields the same events and none twice.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from zlib import crc32

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..config import WATCH_SKIP_DIRS
from ..schemas import WATCH_EVENTS


def look(root: str) -> dict[str, list[int]]:
    """``path: [size, time of change in ns]`` of the files below ``root``, with forward slashes; skipped folders and links to folders aren't entered."""
    found: dict[str, list[int]] = {}
    todo = [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except OSError:  # gone meanwhile
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in WATCH_SKIP_DIRS:
                        todo.append(e.path)
                elif e.is_file():
                    s = e.stat()
                    found[os.path.relpath(e.path, root).replace(os.sep, "/")] = [s.st_size, s.st_mtime_ns]
            except OSError:
                continue
    return found


def differences(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str]]:
    """``path, kind`` of what changed, by path."""
    kinds = {p: "created" if p not in old else "modified" for p, own in new.items() if old.get(p) != own}
    kinds |= {p: "deleted" for p in old if p not in new}
    return sorted(kinds.items())


class Slice(InputPartition):
    def __init__(self, start: int, end: int, number: int, of: int):
        self.start, self.end, self.number, self.of = start, end, number, of


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = (options[k].removeprefix("file://").rstrip("/") for k in ("path", "state"))
        self.slices = int(options.get("slices", "4"))
        self.everything = options.get("existing", "false").lower() == "true"

    def _file(self, version: int) -> str:
        return f"{self.state}/{version:012d}.json"

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(self.state) if n.endswith(".json")) if os.path.isdir(self.state) else []

    def _read(self, version: int) -> dict:
        with open(self._file(version), encoding="utf-8") as f:
            return json.load(f)

    def _write(self, version: int, files: dict[str, list[int]]) -> None:
        os.makedirs(self.state, exist_ok=True)
        with open(self._file(version) + ".tmp", "w", encoding="utf-8") as f:
            json.dump({"at": time.time(), "files": files}, f)
        os.replace(self._file(version) + ".tmp", self._file(version))

    def initialOffset(self) -> dict:
        """The tree as it is when the stream is first started (nothing, with ``existing``: then all files are created ones)."""
        if not self._versions():
            self._write(0, {} if self.everything else look(self.root))
        return {"version": self._versions()[0]}

    def latestOffset(self) -> dict:
        self.initialOffset()  # the first look, if there was none
        known = self._versions()
        now = look(self.root)
        if now == self._read(known[-1])["files"]:
            return {"version": known[-1]}
        self._write(known[-1] + 1, now)
        return {"version": known[-1] + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(start["version"], end["version"], k, self.slices) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.start == partition.end:
            return
        new = self._read(partition.end)
        at = datetime.fromtimestamp(new["at"], timezone.utc)
        for k, (path, kind) in enumerate(differences(self._read(partition.start)["files"], new["files"])):
            if crc32(path.encode("utf-8", "replace")) % partition.of == partition.number:
                yield partition.end << 32 | k, at, path, kind

    def commit(self, end: dict) -> None:
        """Snapshots before a finished batch aren't needed any more."""
        for version in self._versions():
            if version < end["version"]:
                os.remove(self._file(version))


class FolderEvents(DataSource):
    """Options: ``path`` (the tree), ``state`` (where snapshots go), ``slices`` (tasks a batch), ``existing`` (files that are there count as created)."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return WATCH_EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderEvents)
