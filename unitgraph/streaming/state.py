"""Changed names of each repository, accumulated in a stream's keyed state (ST2).

Rows are operations: ``set`` gives a name its last change, ``clear`` forgets a repository's
names up to its time, ``touch`` asks for all names of a repository. A repository's names are dealt to slices, so that
a large repository isn't one task's work; clears and touches go to every slice. Work and
output of a batch follow its rows, not the state; the state itself can be read as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPERATIONS = "repo_id bigint, op string, seq bigint, qualified_name string, file_path string, name string, change string"
_VALUE = "file_path string, name string, change string, seq bigint"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ChangedNames(StatefulProcessor):
    """Map state of names, a value of the last clear, and a timer that tells when a key has been quiet.

    Of equal names the row with the greatest ``seq`` counts, whatever the order in which rows
    come; rows that aren't later than their repository's last clear are forgotten.
    """

    def __init__(self, quiet_ms: int | None = None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "qualified_name string", _VALUE)
        self.cleared = handle.getValueState("cleared", "seq bigint")

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["repo_id", "op", "seq", "qualified_name", "file_path", "name", "change"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[str, tuple] = {}
        clear, touched = None, False
        for frame in rows:
            for r in frame.itertuples(index=False):
                seq = int(r.seq)
                if r.op == "set":
                    if r.qualified_name not in latest or latest[r.qualified_name][3] <= seq:
                        latest[r.qualified_name] = (r.file_path, r.name, r.change, seq)
                elif r.op == "clear":
                    clear = seq if clear is None else max(clear, seq)
                else:
                    touched = True
        out: list[tuple] = []
        before = self.cleared.get()[0] if self.cleared.exists() else None
        if clear is not None and (before is None or clear > before):
            self.cleared.update((clear,))
            before = clear
            for (name,), value in list(self.names.iterator()):
                if value[3] <= clear:
                    self.names.removeKey((name,))
            out.append(("clear", clear, None, None, None, None))
        for name, value in latest.items():
            if before is not None and value[3] <= before:
                continue
            old = self.names.getValue((name,)) if self.names.containsKey((name,)) else None
            if old is None or old[3] <= value[3]:
                self.names.updateValue((name,), value)
                if not touched:
                    out.append(("set", value[3], name, *value[:3]))
        if touched:
            out += [("set", v[3], name, *v[:3]) for (name,), v in self.names.iterator()]
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            now = timerValues.getCurrentWatermarkInMs()
            self.handle.registerTimer(max([now, *(v[3] // 1000 for v in latest.values())]) + self.quiet_ms)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [("quiet", v[3], name, *v[:3]) for (name,), v in self.names.iterator()]
        if rows:
            yield self._frame(key, rows)

    def close(self) -> None:
        pass


def accumulate(operations: DataFrame, slices: int = 8, quiet_ms: int | None = None, event_time: str | None = None) -> DataFrame:
    """The log of a stream of ``OPERATIONS``: names as they change, ``clear`` once a slice, all names of repositories that are touched.

    ``seq`` orders a repository's rows (microseconds, where ``quiet_ms`` is used). With ``quiet_ms`` and the
    column ``event_time``, which needs a watermark, the names of a slice come again as ``quiet`` rows once the
    watermark has passed its last change by so many milliseconds. Null repositories or names are left out.
    """
    spark = operations.sparkSession
    spark.conf.set(*_PROVIDER)  # map states and timers are RocksDB's
    known = operations.where("repo_id is not null and seq is not null and (op <> 'set' or qualified_name is not null)")
    own = F.when(F.col("op") == "set", F.array(F.pmod(F.hash("qualified_name"), F.lit(slices)))).otherwise(F.sequence(F.lit(0), F.lit(slices - 1)))
    columns = [c.strip().split(" ")[0] for c in OPERATIONS.split(",")]
    rows = known.select(*columns, *([event_time] if event_time else []), F.explode(own).alias("slice"))
    keyed = rows.groupBy("repo_id", "slice")
    return keyed.transformWithStateInPandas(ChangedNames(quiet_ms), OPERATIONS, "Update", "None" if quiet_ms is None else "EventTime")


def accumulated(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """``repo_id, qualified_name, file_path, name, change, seq``: the state behind a checkpoint of :func:`accumulate`, after its last batch or an earlier one."""
    spark.conf.set(*_PROVIDER)
    reader = spark.read.format("statestore").option("stateVarName", "names")
    rows = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return rows.select("key.repo_id", "user_map_key.qualified_name", "user_map_value.file_path", "user_map_value.name", "user_map_value.change", "user_map_value.seq")
