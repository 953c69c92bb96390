"""Tables of a code base that are changed in place: a change writes the buckets of its files, and nothing else (K1-K5).

Rows lie in buckets of (repository, file). Each write of a table is a Parquet folder of its
own, partitioned by bucket, and is never changed. A manifest, a small JSON file, names the
write that holds each bucket of each table; it is switched last and for all tables at once,
so a run that fails, or one that is tried again, leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import replace_by_file

FILE = ["repo_id", "file_path"]


class Store:
    """Named tables (``tables``: schema of each, with ``repo_id`` and ``file_path``) below ``folder``.

    ``buckets`` is fixed when the store is made. The last ``keep`` versions can be read
    while newer ones are written; what only older ones name is deleted by :meth:`clean`.
    One writer at a time: a second one finds its version taken and fails.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], buckets: int = 64, keep: int = 3):
        self.spark, self.folder, self.tables, self.keep = spark, folder.rstrip("/"), tables, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest().get("buckets", buckets)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one by default) consists of: ``live`` writes by table and bucket, ``batches`` by writer."""
        known = self.versions()
        if not known:
            return {"live": {}, "batches": {}}
        stream = self._files.open(self._path(f"{self.folder}/manifest/{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, version: int, manifest: dict) -> None:
        name = f"{self.folder}/manifest/{version:012d}"
        if self._files.exists(self._path(name + ".json")):
            raise RuntimeError(f"version {version} of {self.folder} was written by another run")
        out = self._files.create(self._path(name + ".tmp"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files.rename(self._path(name + ".tmp"), self._path(name + ".json")):
            raise RuntimeError(f"version {version} of {self.folder} could not be switched to")

    def bucket(self) -> Column:
        return F.pmod(F.hash(*[F.col(c) for c in FILE]), F.lit(self.buckets))

    def _rows(self, name: str, live: dict[str, dict[str, int]], only: set[int] | None = None) -> DataFrame:
        own = {int(b): w for b, w in live.get(name, {}).items() if only is None or int(b) in only}
        if not own:
            return self.spark.createDataFrame([], self.tables[name])
        home = f"{self.folder}/{name}"
        paths = [f"{home}/write={w}/bucket={b}" for b, w in sorted(own.items())]
        return self.spark.read.schema(self.tables[name]).parquet(*paths)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(name, self.manifest(version)["live"])

    def read_files(self, name: str, files: DataFrame) -> DataFrame:
        """Rows of some files (``repo_id, file_path``), from their buckets only."""
        own = self._rows(name, self.manifest()["live"], self._touched(files))
        return own.join(files.select(*FILE).distinct(), FILE, "left_semi")

    def _touched(self, files: DataFrame) -> set[int]:
        # at most as many numbers as there are buckets
        return {r[0] for r in files.select(self.bucket().alias("b")).distinct().collect()}

    def done(self, batch: tuple[str, int] | None) -> bool:
        """Whether a writer's batch is part of the current version."""
        return batch is not None and self.manifest()["batches"].get(batch[0], -1) >= batch[1]

    def replace(self, files: DataFrame, fresh: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> list[int]:
        """A version in which all rows of ``files`` (gone ones too) are those of ``fresh``; returns the buckets that were written.

        Tables that ``fresh`` lacks stay as they are, rows of it outside ``files`` are left out.
        ``batch`` (a writer's name and number) takes effect once, however often it is tried.
        """
        if self.done(batch):
            return []
        # the files are found once: buckets and all tables' joins read what is written here
        where = f"{self.folder}/asked/{uuid.uuid4().hex}"
        found = files.select(*FILE).distinct()
        try:
            found.write.parquet(where)
            asked = self.spark.read.schema(found.schema).parquet(where)
            return self._write({name: (asked, new) for name, new in fresh.items()}, self._touched(asked), batch)
        finally:
            self._files.delete(self._path(where), True)

    def delete_repositories(self, repos: DataFrame) -> list[int]:
        """A version without the rows of some repositories (``repo_id``) in any table."""
        live = self.manifest()["live"]
        touched: set[int] = set()
        for name in live:
            touched |= self._touched(self._rows(name, live).select(*FILE).join(repos.select("repo_id").distinct(), "repo_id", "left_semi"))
        return self._write({name: (repos.select("repo_id").distinct(), None) for name in live}, touched, None)

    def _write(self, changes: dict[str, tuple[DataFrame, DataFrame | None]], touched: set[int], batch: tuple[str, int] | None) -> list[int]:
        if not touched and batch is None:
            return []
        before = self.manifest()
        version = (self.versions() or [-1])[-1] + 1
        live = {name: dict(own) for name, own in before["live"].items()}
        for name, (keys, new) in changes.items():
            none = self.spark.createDataFrame([], self.tables[name])
            made = none if new is None else new.join(keys, keys.columns, "left_semi")
            if any(int(b) in touched for b in live.get(name, {})):
                made = replace_by_file(self._rows(name, live, touched), made, keys, keys.columns)
            # adaptive execution joins small buckets and splits large ones
            rows = made.select(*none.columns).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
            where = f"{self.folder}/{name}/write={version}"
            rows.write.mode("overwrite").partitionBy("bucket").parquet(where)
            own = {b: w for b, w in live.get(name, {}).items() if int(b) not in touched}
            own |= {n.removeprefix("bucket="): version for n in self._names(where) if n.startswith("bucket=")}
            live[name] = own
        batches = dict(before["batches"])
        if batch is not None:
            batches[batch[0]] = batch[1]
        self._switch(version, {"buckets": self.buckets, "live": live, "batches": batches})
        return sorted(touched)

    def clean(self) -> list[str]:
        """Delete manifests before the ``keep`` last, and writes that none of the others names; returns their folders.

        Not while a writer is at work: its write has no manifest yet.
        """
        versions = self.versions()
        for v in versions[: -self.keep]:
            self._files.delete(self._path(f"{self.folder}/manifest/{v:012d}.json"), False)
        live = [self.manifest(v)["live"] for v in versions[-self.keep :]]
        gone = []
        for name in self.tables:
            used = {w for m in live for w in m.get(name, {}).values()}
            gone += [f"{self.folder}/{name}/{n}" for n in self._names(f"{self.folder}/{name}") if n.startswith("write=") and int(n.removeprefix("write=")) not in used]
        for path in gone:
            self._files.delete(self._path(path), True)
        return gone
