"""Tables around analysis: cache, reports, status, progress, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import percent, slashes
from ..plans.lineage import cut
from .rows import first_by, last_by


def unit_stats(units: DataFrame, languages: list[str]) -> DataFrame:
    """One row a repository: units, and files by language, in a single pass (A1, A2)."""
    files = [F.count_distinct(F.when(F.col("language") == x, F.col("file_path"))).cast("bigint").alias(f"{x}_files") for x in languages]
    return units.groupBy("repo_id").agg(F.count("*").alias("units"), *files)


def scan_counters(current: DataFrame, stored: DataFrame, keys: list[str], hash_col: str = "hash") -> DataFrame:
    """One row: files updated, skipped and in all (A10)."""
    old = stored.select(*keys, F.col(hash_col).alias("_old"))
    same = F.coalesce(F.col("_old") == F.col(hash_col), F.lit(False))
    return current.join(old, keys, "left").agg(F.count_if(~same).alias("updated"), F.count_if(same).alias("skipped"), F.count("*").alias("total"))


def scan_summary(units: DataFrame, scans: DataFrame, vectors: DataFrame) -> DataFrame:
    """``repo_id, scan_id, updated_units, updated_files, mode`` of each repository's scan.

    ``units`` carry the ``scan_id`` that wrote them, ``scans`` (``repo_id, scan_id, force``) names the scan to
    sum up, ``vectors`` (``repo_id, n``) tells how many vectors are stored. Mode ``updated``: the units of that scan or
    later ones are embedded; ``rebuild``: all, as the scan was forced, or nothing was updated and no vector is
    there; ``none``: nothing. A rebuild counts all units.
    """
    joined = units.select("repo_id", "file_path", F.col("scan_id").alias("_written")).join(scans, "repo_id", "right")
    fresh = F.col("_written") >= F.col("scan_id")
    counted = joined.groupBy("repo_id", "scan_id", "force").agg(
        F.count_if(fresh).alias("_new"), F.count_distinct(F.when(fresh, F.col("file_path"))).alias("_new_files"), F.count("file_path").alias("_all"), F.count_distinct("file_path").alias("_files")
    )
    stored = counted.join(vectors.select("repo_id", F.col("n").alias("_vectors")), "repo_id", "left")
    rebuild = (F.col("_all") > 0) & (F.coalesce("force", F.lit(False)) | ((F.col("_new") == 0) & (F.coalesce("_vectors", F.lit(0)) == 0)))
    mode = F.when(rebuild, "rebuild").when(F.col("_new") > 0, "updated").otherwise("none")
    shown = lambda one, whole: F.when(rebuild, F.col(whole)).otherwise(F.col(one))
    return stored.select("repo_id", "scan_id", shown("_new", "_all").alias("updated_units"), shown("_new_files", "_files").alias("updated_files"), mode.alias("mode"))


def units_to_embed(units: DataFrame, scans: DataFrame, vectors: DataFrame) -> DataFrame:
    """The units that a repository's scan hands on to be embedded (see :func:`scan_summary`)."""
    # a row a repository
    modes = scan_summary(units, scans, vectors).where("mode <> 'none'").select("repo_id", F.col("scan_id").alias("_since"), "mode")
    kept = units.join(modes, "repo_id").where((F.col("mode") == "rebuild") | (F.col("scan_id") >= F.col("_since")))
    return kept.select(*[F.col(f"`{c}`") for c in units.columns])


def cache_overlay(hits: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the finished cache row of their key; ``cached`` tells whether there is one."""
    done = cache.where("status = 'done'").drop("status")
    return hits.join(done.withColumn("cached", F.lit(True)), keys, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def cache_misses(hits: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Keys to generate, each once (the in-flight set)."""
    return hits.select(*keys).distinct().join(cache.where("status = 'done'").select(*keys), keys, "left_anti")


def cache_state(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Status of each key after its log of pending / done / error / read; done is final (K7).

    ``hit_count``: reads that found a finished row (A11). A read changes no status; a key that
    was only read has none. Window and sum share one exchange.
    """
    finished = F.min(F.when(F.col("status") == "done", F.col(order))).over(Window.partitionBy(*keys))
    rank = F.struct(F.when(F.col("status") == "done", 1).otherwise(0), F.col(order))
    rows = log.withColumn("_finished", finished).withColumn("_written", F.when(F.col("status") != "read", rank))
    hit = (F.col("status") == "read") & (F.col(order) > F.col("_finished"))
    return rows.groupBy(*keys).agg(F.max_by("status", "_written").alias("status"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hit_count"))


def recent(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def report_log(stored: DataFrame, fresh: DataFrame, cleared: DataFrame, key: str) -> DataFrame:
    """Reports after an insert and after clearing some repositories (K6)."""
    return stored.unionByName(fresh).join(cleared.select(key).distinct(), key, "left_anti")


def status(repos: DataFrame, live: DataFrame, key: str = "repo_id") -> DataFrame:
    """Live status, else the stored one with an interrupted scan as idle, else idle."""
    stored = F.when(F.col("scan_status") == "scanning", "idle").otherwise(F.col("scan_status"))
    return repos.join(live, key, "left").select(key, F.coalesce("live_status", stored, F.lit("idle")).alias("status"))


def create_repos(repos: DataFrame, fresh: DataFrame) -> DataFrame:
    """Repositories after adding those of ``fresh`` (``name, path``) whose path isn't there yet.

    Paths are unique with forward slashes and without one at the end; of equal new paths
    the first by name counts. Ids go on behind the largest.
    """
    clean = lambda c: F.regexp_replace(slashes(F.col(c)), "(.)/+$", "$1")
    new = first_by(fresh.select("name", clean("path").alias("path")), ["path"], "name").join(repos.select(clean("path").alias("path")), "path", "left_anti")
    top = repos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    # one number a new repository: a table of what somebody registered
    numbered = new.withColumn("_n", F.row_number().over(Window.orderBy("path"))).withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    return repos.select("id", "name", "path").unionByName(numbered.select((F.col("_top") + F.col("_n")).cast(repos.schema["id"].dataType).alias("id"), "name", "path"))


def repos_of_paths(repos: DataFrame, paths: DataFrame) -> DataFrame:
    """``path, id`` of each path asked for; null where no repository has it."""
    clean = lambda c: F.regexp_replace(slashes(F.col(c)), "(.)/+$", "$1")
    known = repos.select(clean("path").alias("_path"), "id")
    return paths.select("path", clean("path").alias("_path")).join(known, "_path", "left").select("path", "id")


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Event log folded to one row a phase: events, last numbers, percent (ST5, R5)."""
    agg = events.groupBy(*keys, "phase").agg(F.count("*").alias("events"), F.max_by("done", "seq").alias("done"), F.max_by("total", "seq").alias("total"))
    return agg.withColumn("percent", percent(F.col("done"), F.col("total")))


def watch_state(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row of each key: what a repository's accumulated changes are (ST2 as a batch)."""
    return last_by(events, keys, *order)


def debounced(events: DataFrame, settings: Settings = DEFAULT, key: str | None = None) -> DataFrame:
    """Bursts of events: ``first_ts, last_ts, events, paths`` (ST1). Each event restarts the timer.

    One timer for all events, unless ``key`` names a column, such as the repository. On a
    stream, which needs a watermark, a burst is a session window, and without a key its key is that there is a
    time. A table's time line is cut into ranges (:func:`numbered_islands`), so that
    one timer isn't one task. Events without a time belong to no burst.
    """
    if events.isStreaming:
        window = F.session_window("ts", f"{settings.debounce_ms} milliseconds")
        groups = [window.alias("_w"), F.col(key) if key else F.col("ts").isNotNull().alias("_any")]
    else:
        own = [key] if key else []
        timed = events.where(F.col("ts").isNotNull()).select("ts", "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), *own)
        events = numbered_islands(timed, own, "_at", "_at", settings.debounce_ms * 1000)
        groups = [F.col(c) for c in (*own, "island")]
    agg = events.groupBy(*groups).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return agg.select("first_ts", "last_ts", "events", "paths") if key is None else agg.select(key, "first_ts", "last_ts", "events", "paths")


def numbered_islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int, ranges: int | None = None) -> DataFrame:
    """Rows with ``island``, numbered from 0 in each key: a row opens one if it starts more than ``gap`` behind the furthest end before it.

    The rows are dealt to ``ranges`` of (key, start, end) of about equal size, and each is swept alone. What a range
    needs of those before it - the furthest end, and how many islands there are - comes
    from a scan over one row for each key and range. So neither a key with most rows nor a table
    without keys is one task's work. Null starts come first, as Spark sorts them, and open no island.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that all readers see a row in the same range
    dealt = cut(rows.repartitionByRange(n, *keys, start, end).withColumn("_range", F.spark_partition_id()))
    by_range = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(start, end)
    ends = dealt.groupBy(*keys, "_range").agg(F.max(end).alias("_end")).withColumn("_carried", F.max("_end").over(by_range)).drop("_end")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        same = F.col("l._range") == F.col("r._range")
        for k in keys:
            same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
        added = [F.col(f"r.`{c}`") for c in right.columns if c not in (*keys, "_range")]
        return left.alias("l").join(right.alias("r"), same).select("l.*", *added)

    before = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    opened = joined(dealt, ends).withColumn("_new", F.when(F.col(start) - before > gap, 1).otherwise(0)).withColumn("_here", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    counts = opened.groupBy(*keys, "_range").agg(F.sum("_new").alias("_count")).withColumn("_before", F.coalesce(F.sum("_count").over(by_range), F.lit(0))).drop("_count")
    return joined(opened, counts).withColumn("island", (F.col("_here") + F.col("_before")).cast("int")).select(*[F.col(f"`{c}`") for c in rows.columns], "island")


def merged_gaps(rows: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Neighbouring ranges joined while the gap to the furthest end so far is at most ``gap`` (EX15, W2).

    Returns the rows with ``island``, numbered from 0 in each key (see :func:`numbered_islands`).
    """
    return numbered_islands(rows, keys, start, end, gap)


def impact_report(chains: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, direct, indirect, report``: nodes as text, direct ones all, of the others the first few."""
    # places are numbered within a start, so that one exchange serves the ranking and the grouping
    w = Window.partitionBy("start_qn").orderBy(F.col("depth") != 1, "depth", "qualified_name")
    nodes = chains.where("start_qn is not null").withColumn("_place", F.row_number().over(w))
    direct = F.count_if(F.col("depth") == 1)
    line = F.concat(F.lit("[depth "), F.col("depth").cast("string"), F.lit("] "), F.col("qualified_name"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_place") <= F.col("_direct") + settings.indirect_limit, F.struct("depth", "qualified_name", line.alias("line")))))
    rows = nodes.withColumn("_direct", direct.over(Window.partitionBy("start_qn")))
    return rows.groupBy("start_qn").agg(direct.alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("report"))
