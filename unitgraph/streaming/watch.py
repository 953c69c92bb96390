"""The watcher as a stream: events -> bursts -> changed units -> state and impact (SC11, ST1-ST5, K8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import DEFAULT, Settings
from ..functions.columns import watched
from ..operators import graph as G
from ..operators import rows as R
from ..operators import service as S
from ..plans.lineage import cut
from ..plans.store import FILE, Store
from ..schemas import WATCH_EVENTS
from .state import OPERATIONS, accumulate



def event_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Watch events (``seq, ts, path, kind``) that arrive as JSON files; only watched source files."""
    events = spark.readStream.schema(WATCH_EVENTS).option("maxFilesPerTrigger", max_files).json(folder)
    return events.where(watched(F.col("path")))


def bursts(events: DataFrame, delay: str = "5 seconds", settings: Settings = DEFAULT) -> DataFrame:
    """Debounced bursts of a stream. The watermark is event time: what comes later than ``delay`` behind it is dropped."""
    return S.debounced(events.withWatermark("ts", delay), settings)


@dataclass
class Parsed:
    """What re-parsing some paths gives: units, edges and file hashes, each with ``repo_id, file_path``; ``files`` are the files looked at, gone ones too."""

    files: DataFrame
    units: DataFrame
    edges: DataFrame
    hashes: DataFrame


def watch_loop(stream: DataFrame, store: Store, reparse: Callable[[DataFrame], Parsed], changes: str, checkpoint: str) -> StreamingQuery:
    """Start the loop (ST3): of each burst re-parse the paths, find changed units, and bring the store up to date.

    ``reparse`` maps ``path`` rows to :class:`Parsed`. Only the buckets of files that it looked
    at are read and written. Changed names go to the folder ``changes`` as operations for
    :func:`report_loop`, before the store's version is switched: a batch that runs again finds
    either the old version and repeats its work, or the new one and does nothing.
    """
    writer = f"watch:{checkpoint}"

    def step(batch: DataFrame, batch_id: int) -> None:
        if store.done((writer, batch_id)):
            return
        at = F.unix_micros(F.coalesce(F.lit(batch.agg(F.max("last_ts")).first()[0]).cast("timestamp"), F.timestamp_seconds(F.lit(0))))
        fresh = reparse(batch.select(F.explode("paths").alias("path")).distinct())
        files = fresh.files.select(*FILE).distinct()
        # what is parsed anew is read once by each step below
        units = cut(fresh.units.join(files, FILE, "left_semi"))
        changed = R.changed_units(units, store.read_files("units", files), [*FILE, "qualified_name", "signature"])
        named = R.first_by(changed, ["repo_id", "qualified_name"], "file_path").select("repo_id", F.lit("set").alias("op"), at.alias("seq"), "qualified_name", "file_path", "name", "change")
        touched = files.select("repo_id").distinct().select("repo_id", F.lit("touch").alias("op"), at.alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("qualified_name", "file_path", "name", "change")])
        named.unionByName(touched).write.mode("overwrite").parquet(f"{changes.rstrip('/')}/batch={batch_id}")
        store.replace(files, {"units": units, "edges": fresh.edges, "hashes": fresh.hashes}, (writer, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(spark: SparkSession, changes: str, clears: str | None = None) -> DataFrame:
    """Operations of :func:`watch_loop`, and clears (``repo_id, seq``, in microseconds) that arrive as JSON files."""
    found = spark.readStream.schema(OPERATIONS).parquet(f"{changes.rstrip('/')}/batch=*")
    if clears is None:
        return found
    asked = spark.readStream.schema("repo_id bigint, seq bigint").json(clears)
    return found.unionByName(asked.withColumn("op", F.lit("clear")), allowMissingColumns=True)


def report_loop(operations: DataFrame, store: Store, sink: Callable[[DataFrame, int], None], checkpoint: str, slices: int = 8, settings: Settings = DEFAULT) -> StreamingQuery:
    """Start the reports: names accumulate in keyed state, and a burst reports the impact of all accumulated names of its repositories.

    ``sink`` gets the chains of each batch; an empty batch of names gives it none.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        names = cut(batch.where("op = 'set'").select(F.col("qualified_name").alias("start_qn")).distinct())
        sink(G.impact_chains(names, store.read("edges"), store.read("units"), settings), batch_id)

    return accumulate(operations, slices).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch's chains as JSON frames, a folder a batch, replaced if the batch runs again (K8)."""

    def write(chains: DataFrame, batch: int) -> None:
        frame = F.concat(F.lit("data: "), F.to_json(F.struct(*chains.columns)), F.lit("\n"))
        chains.select(frame.alias("frame")).write.mode("overwrite").text(f"{folder.rstrip('/')}/batch={batch}")

    return write


class ProgressLog(StreamingQueryListener):
    """Progress of streaming queries as rows of ``seq, phase, done, total`` (ST5)."""

    def __init__(self, limit: int = 100):
        self.rows: list[tuple[int, str, int, int]] = []
        self.limit, self.seq = limit, 0

    def _add(self, phase: str, done: int, total: int) -> None:
        self.seq += 1
        self.rows = [*self.rows, (self.seq, phase, done, total)][-self.limit :]

    def onQueryStarted(self, event) -> None:
        self._add("started", 0, 0)

    def onQueryProgress(self, event) -> None:
        self._add("progress", int(event.progress.batchId), int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        self._add("heartbeat", 0, 0)

    def onQueryTerminated(self, event) -> None:
        self._add("error" if event.exception else "complete", 0, 0)
