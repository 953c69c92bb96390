"""Substring search over an index of grams: posting lists, the rarest of a word's grams intersected, matches verified.

A word is split at its wildcards (``%``, ``_``) into literal pieces. A piece of three or more
characters is looked up by its trigrams, a shorter one by itself, a word of wildcards
only by the empty gram that every row has: the index holds grams of 0 to 3 characters,
but only those are made that some word asks for.

Where only the first rows of each word are wanted, up to ``SCAN`` words are expressions of one
scan. More are looked up in the rows that come first, then in more of them, and only words that have
not found enough go on; words of letters by way of the texts' own different words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ascii_fold
from ..plans.lineage import cut, only_named

#: Grams of a word that are intersected.
RAREST = 2
#: Words that one scan looks for, and letters of the longest word that is looked up among the texts' words.
SCAN, LONGEST = 256, 32
#: Shares of the rows, in their order, that are searched first; their bounds are estimated from a sample of names.
SHARES, SAMPLE = (1 / 64, 1 / 8), 4096


def text_grams(text: Column, sizes: tuple[int, ...] = (0, 1, 2, 3)) -> Column:
    """The different grams of a text, by one pass of a lookahead for each size."""
    found = [F.array(F.lit(""))] if 0 in sizes else []
    found += [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes if n]
    return F.array_distinct(F.flatten(F.array(*found)))


def word_grams(word: Column) -> Column:
    """Grams that every match of a folded LIKE word has (see the module's text)."""
    pieces = F.filter(F.split(word, "[%_]"), lambda p: p != "")
    grams = F.flatten(F.transform(pieces, lambda p: F.when(F.char_length(p) >= 3, F.regexp_extract_all(p, F.lit("(?s)(?=(.{3}))"), F.lit(1))).otherwise(F.array(p))))
    return F.array_distinct(F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit(""))))


def postings(rows: DataFrame, key: str, columns: list[str], asked: DataFrame | None = None) -> DataFrame:
    """``gram, key``: which rows have a gram in one of their (folded) columns; only grams of ``asked`` (``gram``), if given.

    The sizes of grams that are asked for are looked up first, so short grams cost nothing
    unless somebody asks. Written to a table, this is the index.
    """
    sizes = (0, 1, 2, 3)
    if asked is not None:
        # at most four numbers
        sizes = tuple(r[0] for r in asked.select(F.char_length("gram").alias("n")).distinct().collect())
        if not sizes:
            return rows.select(F.lit("").alias("gram"), F.col(key).alias("key")).limit(0)
    grams = F.array_distinct(F.flatten(F.array(*[text_grams(F.col(c), sizes) for c in columns])))
    listed = rows.select(F.explode(grams).alias("gram"), F.col(key).alias("key"))
    return listed if asked is None else only_named(listed, "gram", asked)


def matches(rows: DataFrame, words: DataFrame, key: str, columns: list[str], index: DataFrame | None = None) -> DataFrame:
    """``word, key``: rows of which a folded column contains a folded word (``%`` and ``_`` are wildcards), each pair once.

    ``key`` tells rows apart. Of each word the ``RAREST`` grams, by the length of their lists, are
    intersected by key, and only rows that are left are compared. Any number of words: none reaches the driver.
    """
    wanted = cut(words.select("word").where("word is not null").distinct().select("word", F.explode(word_grams(F.col("word"))).alias("gram")))
    asked = wanted.select("gram").distinct()
    lists = cut(postings(rows, key, columns, asked) if index is None else only_named(index, "gram", asked))
    length = lists.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no row has makes a word's rarest list an empty one: it has no pairs
    by_length = Window.partitionBy("word").orderBy(F.coalesce("n", F.lit(0)), "gram")
    rarest = wanted.join(length, "gram", "left").withColumn("_place", F.row_number().over(by_length)).where(F.col("_place") <= RAREST)
    sought = rarest.withColumn("_lists", F.count("*").over(Window.partitionBy("word"))).select("word", "gram", "_lists")
    pairs = sought.join(lists, "gram").groupBy("word", "key").agg(F.count("*").alias("_found"), F.max("_lists").alias("_lists")).where("_found = _lists")
    texts = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    pattern = F.concat(F.lit("%"), F.replace("word", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    same = None
    for i in range(len(columns)):
        own = F.when(F.col("word").rlike("[%_]"), F.call_function("like", F.col(f"_t{i}"), pattern)).otherwise(F.contains(F.col(f"_t{i}"), F.col("word")))
        same = own if same is None else same | own
    return pairs.select("word", "key").join(texts, "key").where(same).select("word", "key")


def contains_word(columns: list[str], word: str) -> Column:
    """Whether one of the folded columns contains a folded word (``%`` and ``_`` are wildcards)."""
    if "%" in word or "_" in word:
        found = [F.col(c).like("%" + word.replace("\\", "\\\\") + "%") for c in columns]
    else:
        found = [F.contains(F.col(c), F.lit(word)) for c in columns]
    return reduce(lambda x, y: x | y, found)


def _runs(columns: list[str]) -> Column:
    """The different runs of letters of folded columns: a word of letters lies within one."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0)) for c in columns])))


def runs_of_words(rows: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """``word, run``: the runs of letters in folded columns that contain a word (letters only, ``LONGEST`` at most).

    Pieces of the different runs, of lengths that words have, meet the words by equality.
    """
    lengths = sorted(r[0] for r in words.select(F.char_length("word")).distinct().collect())  # LONGEST numbers at most
    different = rows.select(F.explode(_runs(columns)).alias("run")).distinct()
    ends = different.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("at")).select("run", F.expr(f"substring(run, at, {LONGEST})").alias("end"))
    # an end of n letters has only pieces of lengths up to n
    upto = F.array(*[F.lit(sum(n <= size for n in lengths)) for size in range(LONGEST + 1)])
    own = F.slice(F.array(*map(F.lit, lengths)), F.lit(1), F.element_at(upto, F.char_length("end") + 1))
    pieces = ends.select("run", "end", F.explode(own).alias("n")).select("run", F.expr("substring(end, 1, n)").alias("word"))
    return only_named(pieces, "word", words).distinct()


def first_matches(rows: DataFrame, words: DataFrame, key: str, columns: list[str], order: list[str], limit: int) -> DataFrame:
    """``word, key`` and ``order``: the first ``limit`` rows of :func:`matches` for each word, by ``order`` and ``key``. Nothing is left out.

    A word has ``limit`` rows at most behind each step, so a word that many rows contain costs no more than others.
    """
    own = words.select("word").where("word is not null").distinct()

    def first(found: DataFrame, name: str = "word") -> DataFrame:
        w = Window.partitionBy(name).orderBy(*order, "key")
        return found.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= limit).drop("_place")

    bare = rows.withColumnRenamed(key, "key").select("key", *order, *[c for c in columns if c not in order])
    few = [r[0] for r in own.limit(SCAN + 1).collect()]
    if len(few) <= SCAN:
        found = F.array_compact(F.array(*[F.when(contains_word(columns, w), F.lit(w)) for w in sorted(few)])) if few else F.array().cast("array<string>")
        return first(bare.select(F.explode(found).alias("word"), "key", *order))
    left = cut(own)
    plain = F.col("word").rlike(rf"^[a-z]{{1,{LONGEST}}}\z")
    runs = cut(runs_of_words(bare, left.where(plain), columns)) if left.where(plain).limit(1).count() else None
    names = bare.where(F.col(order[0]).isNotNull()).select(F.col(order[0]).alias("name"), F.xxhash64("key").alias("h")).orderBy("h", "name").limit(SAMPLE)
    sample = names.agg(F.array_sort(F.collect_list("name"))).first()[0]
    bounds = sorted({sample[int(len(sample) * share)] for share in SHARES}) if sample else []
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        name = F.col(order[0])
        part = bare.where(F.lit(True) if low is None and high is None else (name.isNull() | (name <= high)) if low is None else (name > low) if high is None else (name > low) & (name <= high))
        found = matches(part, left.where(~plain), "key", columns).join(part.select("key", *order), "key").select("word", "key", *order) if left.where(~plain).limit(1).count() else None
        if runs is not None:
            asked = runs.join(left, "word", "left_semi")
            listed = only_named(part.select("key", *order, F.explode(_runs(columns)).alias("run")), "run", asked.select("run").distinct())
            by_run = first(listed, "run").join(asked, "run").select("word", "key", *order).distinct()
            found = by_run if found is None else found.union(by_run)
        parts.append(cut(first(found)))
        if high is not None:
            # all that comes later is behind what was found
            full = reduce(DataFrame.union, parts).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
            left = cut(left.join(full, "word", "left_anti"))
            if not left.limit(1).count():
                break
    return first(reduce(DataFrame.union, parts))


def folded_rows(units: DataFrame, columns: list[str]) -> DataFrame:
    """``_key``, a number for each row, the row as ``_unit``, and its folded columns ``_f0``, ``_f1``...: a table of its own, so that numbers stay."""
    folded = [ascii_fold(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(f"_f{i}") for i, c in enumerate(columns)]
    return cut(units.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in units.columns]).alias("_unit"), *folded))


def hits(units: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """Units with ``query_id`` for each query (``query_id, word``) that has a word contained in one of ``columns``; a unit meets a query once."""
    own = words.where("query_id is not null and word is not null").select("query_id", ascii_fold(F.col("word")).alias("word")).distinct()
    rows = folded_rows(units, columns)
    found = matches(rows, own, "_key", [f"_f{i}" for i in range(len(columns))])
    pairs = found.join(own, "word").select("key", "query_id").distinct()
    return pairs.join(rows.select(F.col("_key").alias("key"), "_unit"), "key").select("_unit.*", "query_id")


def first_by_query(units: DataFrame, words: DataFrame, columns: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` units of :func:`hits` for each query, in order of columns ``order``, with ``query_id, place``.

    Words find their first units once, whatever the number of queries that have them.
    """
    own = words.where("query_id is not null and word is not null").select("query_id", ascii_fold(F.col("word")).alias("word")).distinct()
    rows = folded_rows(units, columns)
    sorted_by = [F.col(f"_unit.`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    folded = [f"_f{i}" for i in range(len(columns))]
    found = cut(first_matches(rows.select("_key", *sorted_by, *folded), own, "_key", folded, names, limit))
    w = Window.partitionBy("query_id").orderBy(*names, "key")
    pairs = found.join(own, "word").select("key", "query_id", *names).distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    # the units that some word found, by key: a few for each different word
    wanted = rows.withColumnRenamed("_key", "key").join(found.select("key").distinct(), "key", "left_semi").select("key", "_unit")
    return pairs.select("key", "query_id", "place").join(wanted, "key").select("_unit.*", "query_id", "place")


def first_hits(units: DataFrame, typed: DataFrame, limit: int = 20) -> DataFrame:
    """``query_id, place`` and the units whose name or qualified name contains what was typed (``query_id, typed``), by name: autocomplete for any number of queries.

    White space around a text is dropped, a blank one has no hits; ``limit`` is 1 to 50.
    """
    words = typed.select("query_id", F.trim("typed").alias("word")).where("word <> ''")
    return first_by_query(units, words, ["name", "qualified_name"], ["name", "qualified_name"], max(1, min(limit, 50)))
