"""Call graph: bounded reverse traversal for many starts at once, node details, overlap with hunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import callee_patterns, short_name, slashes
from ..plans.lineage import SMALL, cut, maybe_named, only_named
from .rows import first_by


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """``callee, callers`` (sorted, distinct) of each callee."""
    return edges.groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def _patterns(nodes: DataFrame, settings: Settings) -> DataFrame:
    """``start_qn, qualified_name, callee``: the names by which a node is called."""
    return nodes.select("start_qn", "qualified_name", F.explode(callee_patterns(F.col("qualified_name"), settings)).alias("callee"))


def next_frontier(frontier: DataFrame, edges: DataFrame, visited: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, qualified_name``: callers of the frontier that haven't been visited from that start."""
    patterns = _patterns(frontier, settings).drop("qualified_name")
    asked = only_named(edges.select("caller", "callee"), "callee", patterns.select("callee").distinct())
    callers = patterns.join(asked, "callee").select("start_qn", F.col("caller").alias("qualified_name")).distinct()
    return callers.join(visited.select("start_qn", "qualified_name"), ["start_qn", "qualified_name"], "left_anti")


#: Lines of the smallest bins in which units and ranges meet.
BIN = 16
#: Starts whose sets share one number.
WORD = 64


def _one(bit: Column) -> Column:
    """The number in which only ``bit`` is set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each set bit of ``mask``, as ``bit``."""
    mask = F.col("mask")
    several = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("mask", k) == 1)
    # in a wide graph nearly all sets are of one start: its place is the number of zeros below it
    lowest = F.bit_count(F.bitwise_not(mask).bitwiseAND(F.when(mask > 0, mask).otherwise(1) - 1)).cast("int")
    bits = F.when(mask < 0, several).when(F.bit_count(mask) == 1, F.array(lowest)).otherwise(several)
    return rows.select(*columns, "chunk", F.explode(bits).alias("bit"))


def _only(rows: DataFrame, states: DataFrame, which: str) -> DataFrame:
    """``rows`` with the starts that column ``which`` of ``states`` (a row a chunk) holds."""
    joined = rows.join(states.select("chunk", F.col(which).alias("_which")), "chunk").withColumn("mask", F.col("mask").bitwiseAND(F.col("_which")))
    return joined.where("mask <> 0").select("qualified_name", "chunk", "mask")


def next_sets(frontier: DataFrame, edges: DataFrame, visited: DataFrame, settings: Settings = DEFAULT, few: bool = False) -> DataFrame:
    """``qualified_name, chunk, mask``: callers of the frontier's nodes, with the starts that haven't visited them.

    ``frontier`` and ``visited`` have those columns too. The edges are read once for all
    starts, and an edge gives at most a row for each chunk of starts that asks for it.
    ``few``: the frontier is known to have few enough rows to be broadcast.
    """
    patterns = frontier.select(F.explode(callee_patterns(F.col("qualified_name"), settings)).alias("callee"), "chunk", "mask")
    # few of the edges are asked for, as a rule: the others go before they are grouped or shuffled
    asked = maybe_named(edges.select("caller", "callee"), "callee", patterns)
    callers = asked.join(F.broadcast(patterns) if few else patterns, "callee").groupBy(F.col("caller").alias("qualified_name"), "chunk").agg(F.bit_or("mask").alias("mask"))
    seen = visited.groupBy("qualified_name", "chunk").agg(F.bit_or("mask").alias("seen"))
    fresh = callers.join(seen, ["qualified_name", "chunk"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint")))))
    return fresh.where("mask <> 0").select("qualified_name", "chunk", "mask")


def upstream_sizes(starts: DataFrame, edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, depth, nodes``: the rows of :func:`upstream`, counted.

    Starts with more callers than room take as many as there is room and ask no further, so
    which they are isn't asked: nothing is ranked, and no row a node is made.
    """
    return _search(starts, edges, settings, True)


def upstream(starts: DataFrame, edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, qualified_name, depth`` of all that call each start, directly or not (G1).

    An edge may come several times. Level by level, depth ``max_depth`` at most; of each start at most ``max_nodes``
    nodes, itself included, are kept: those of a level in order of their name (Q4).
    Starts are numbered, and a node holds sets of them, ``WORD`` to a number: a level reads the
    edges once, whatever the number of starts, and shuffles a row for each caller and chunk of
    starts. Only starts for which a level has more than their room are unpacked and ranked,
    the rank's limit applied before the shuffle. Starts that have no room left ask for no edges, and
    a level that nobody asks for isn't computed.
    """
    return _search(starts, edges, settings, False)


def _search(starts: DataFrame, edges: DataFrame, settings: Settings, sizes: bool) -> DataFrame:
    named = starts.select("start_qn").where("start_qn is not null").distinct().sortWithinPartitions("start_qn").withColumn("_n", F.monotonically_increasing_id())
    # numbers are consecutive within a partition, so a chunk is of one partition; they are written, and so the same for all readers
    numbers = cut(named.select("start_qn", F.floor(F.col("_n") / WORD).alias("chunk"), (F.col("_n") % WORD).cast("int").alias("bit")))
    frontier = numbers.select(F.col("start_qn").alias("qualified_name"), "chunk", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")).alias("mask"))
    levels = [frontier]
    counts = [numbers.select("chunk", "bit", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("nodes"))]
    room = numbers.select("chunk", "bit", F.lit(settings.max_nodes - 1).cast("bigint").alias("room")).where("room > 0")
    rows = numbers.count()
    for depth in range(1, settings.max_depth + 1):
        fresh = cut(next_sets(frontier, edges, reduce(DataFrame.unionByName, levels), settings, rows <= SMALL))
        found = _unpacked(fresh).groupBy("chunk", "bit").agg(F.count("*").alias("found"))
        # a row for each start that has room and finds something: the frontier holds no others
        states = cut(room.join(found, ["chunk", "bit"]))
        fits, more = F.col("found") <= F.col("room"), F.col("found") < F.col("room")
        masks = states.groupBy("chunk").agg(*[F.bit_or(F.when(c, _one(F.col("bit"))).otherwise(F.lit(0).cast("bigint"))).alias(n) for n, c in (("whole", fits), ("over", ~fits), ("left", more))])
        rows, crowded, asking = states.agg(F.coalesce(F.sum(F.least("found", "room")), F.lit(0)), F.count_if(~fits), F.count_if(more)).first()
        level = _only(fresh, masks, "whole")
        counts.append(states.select("chunk", "bit", F.lit(depth).alias("depth"), F.least("found", "room").alias("nodes")))
        if crowded and not sizes:
            by_name = Window.partitionBy("chunk", "bit").orderBy("qualified_name")
            ranked = _unpacked(_only(fresh, masks, "over"), "qualified_name").withColumn("_rank", F.row_number().over(by_name)).where(F.col("_rank") <= settings.max_nodes)
            kept = ranked.join(states.select("chunk", "bit", "room"), ["chunk", "bit"]).where("_rank <= room")
            packed = kept.groupBy("qualified_name", "chunk").agg(F.bit_or(_one(F.col("bit"))).alias("mask"))
            level = cut(level.unionByName(packed))
        levels.append(level)
        if not asking:
            break
        frontier = _only(fresh, masks, "left")
        room = states.where(more).select("chunk", "bit", (F.col("room") - F.col("found")).alias("room"))
    if sizes:
        return reduce(DataFrame.unionByName, counts).join(numbers, ["chunk", "bit"]).select("start_qn", "depth", "nodes")
    # the same node may be in a level twice, for different starts
    nodes = reduce(DataFrame.unionByName, [_unpacked(level.withColumn("depth", F.lit(k)), "qualified_name", "depth") for k, level in enumerate(levels)])
    return cut(nodes.join(numbers, ["chunk", "bit"]).select("start_qn", "qualified_name", "depth"))


def callers_of(nodes: DataFrame, edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, qualified_name, caller, call_line``: who calls each node, and where (A8, ``via_line`` of Q2)."""
    patterns = _patterns(nodes, settings)
    joined = patterns.join(only_named(edges, "callee", patterns.select("callee").distinct()), "callee")
    return joined.groupBy("start_qn", "qualified_name", "caller").agg(F.min("call_line").alias("call_line"))


def caller_counts(nodes: DataFrame, edges: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, qualified_name, n_callers, first_line`` of nodes that somebody calls: :func:`callers_of`, counted.

    A node is counted once, whatever the number of starts that reach it.
    """
    names = nodes.select("qualified_name").distinct().select(F.col("qualified_name").alias("start_qn"), "qualified_name")
    counted = callers_of(names, edges, settings).groupBy("qualified_name").agg(F.count("*").alias("n_callers"), F.min("call_line").alias("first_line"))
    return nodes.select("start_qn", "qualified_name").join(counted, "qualified_name").select("start_qn", "qualified_name", "n_callers", "first_line")


def node_details(nodes: DataFrame, units: DataFrame, edges: DataFrame, body_chars: int = 400) -> DataFrame:
    """Nodes with the details of their unit and the line that calls the start directly (J5, J6; Q2, Q3, Q5).

    A unit that isn't known has empty fields; of several units of one name the one with
    the lowest file path and line counts. ``call_line`` is 0 for nodes that don't call the
    start by its full or short name (here the list of general names doesn't apply).
    """
    # a bitmap in front is enough: the joins below leave no others
    known = maybe_named(units, "qualified_name", nodes)
    detail = first_by(known, ["qualified_name"], "file_path", "start_line").select(
        "qualified_name", "file_path", "start_line", "signature", "language", F.substring("body_text", 1, body_chars).alias("body_text")
    )
    starts = nodes.select("start_qn").distinct()
    names = starts.select("start_qn", F.explode(F.array_distinct(F.array("start_qn", short_name(F.col("start_qn"))))).alias("callee"))
    direct = names.join(maybe_named(edges, "callee", names), "callee").groupBy("start_qn", F.col("caller").alias("qualified_name")).agg(F.min("call_line").alias("call_line"))
    joined = nodes.join(detail, "qualified_name", "left").join(direct, ["start_qn", "qualified_name"], "left")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("file_path", "signature", "language", "body_text")]
    return joined.select("start_qn", "qualified_name", "depth", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("call_line", F.lit(0)).alias("call_line"), *empty)


def impact_chains(starts: DataFrame, edges: DataFrame, units: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``start_qn, changed, impact_chain`` for each start: its own unit and its nodes by depth and name."""
    nodes = upstream(starts, edges, settings).where("depth > 0")
    details = node_details(nodes, units, edges)
    fields = ["depth", "qualified_name", "file_path", "start_line", "call_line", "signature", "language", "body_text"]
    chains = details.groupBy("start_qn").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("impact_chain"))
    own = first_by(units, ["qualified_name"], "file_path", "start_line").select(
        F.col("qualified_name").alias("start_qn"), F.struct("file_path", "start_line", "end_line", "signature", "language", F.substring("body_text", 1, 600).alias("body_text")).alias("changed")
    )
    return starts.select("start_qn").distinct().join(own, "start_qn", "left").join(chains, "start_qn", "left").withColumn("impact_chain", F.coalesce("impact_chain", F.array()))


def units_of_hunks(units: DataFrame, hunks: DataFrame, exact_end: bool = False) -> DataFrame:
    """Units that a change touches (J2): overlapping a range of their file, or of a file that has none.

    ``hunks``: ``file_path, r_start, r_end`` with null bounds for a file without ranges.
    The end of a range counts as inside (Q17) unless ``exact_end``. Units and ranges of a file
    meet in bins of its lines (:func:`_binned`), so a crowded file is many small groups.
    """
    paths = units.withColumn("_path", slashes(F.col("file_path")))
    ranges = hunks.select(slashes(F.col("file_path")).alias("_path"), "r_start", "r_end").distinct()
    last = F.col("r_end") - 1 if exact_end else F.col("r_end")
    with_ranges = ranges.where(F.col("r_start").isNotNull())
    whole = ranges.select("_path").distinct().join(with_ranges.select("_path").distinct(), "_path", "left_anti")
    spans = paths.select("_path", F.col("start_line").alias("_from"), F.col("end_line").alias("_to")).distinct()
    h = with_ranges.select("_path", F.col("r_start").alias("_from"), last.alias("_to"))
    top = spans.select(_level().alias("n")).union(h.select(_level())).agg(F.max("n")).first()[0] or 0
    u, v = _binned(spans, top).alias("u"), _binned(h, top).alias("v")
    same = (F.col("u._path") == F.col("v._path")) & (F.col("u._size") == F.col("v._size")) & (F.col("u._bin") == F.col("v._bin"))
    meet = (F.col("u._own") == F.col("u._size")) | (F.col("v._own") == F.col("v._size"))
    touched = u.join(v, same & meet & (F.col("u._from") <= F.col("v._to")) & (F.col("u._to") >= F.col("v._from")), "left_semi")
    found = touched.select("_path", F.col("_from").alias("start_line"), F.col("_to").alias("end_line")).distinct()
    return paths.join(found, ["_path", "start_line", "end_line"], "left_semi").select(*paths.columns).unionByName(paths.join(whole, "_path", "left_semi")).drop("_path")


def _level() -> Column:
    """The smallest size of bins (a power of two, times ``BIN``) of which a span ``_from, _to`` meets two at most."""
    length = F.abs(F.col("_to") - F.col("_from")) + 1
    return F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(float(BIN))))).cast("int")


def _binned(spans: DataFrame, top: int) -> DataFrame:
    """Spans ``_from, _to`` with the bins that they meet (``_size, _bin``): of their own size (``_own``) and of all larger ones up to ``top``.

    Two spans that overlap share a bin of the larger one's own size, so that a long
    span meets short ones in few rows. Spans without lines are left out.
    """
    leveled = spans.where(F.col("_from").isNotNull() & F.col("_to").isNotNull()).withColumn("_own", _level())
    sized = leveled.withColumn("_size", F.explode(F.sequence(F.col("_own"), F.lit(top))))
    place = lambda c: F.floor(c / (F.lit(BIN) * F.pow(F.lit(2.0), F.col("_size"))))
    ends = F.array_distinct(F.array(place(F.col("_from")), place(F.col("_to"))))
    return sized.withColumn("_bin", F.explode(ends))
