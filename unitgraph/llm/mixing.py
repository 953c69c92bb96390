"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with the same copy rate ``target / source size``;
its whole part is certain, its fractional part is a probability. Two documents are
paired and probability mass (counted in words) moves between them, in a random
direction that keeps both expectations, until one of them is 0 or 1 - so the words
of the pair stay what they were. The other goes on to the next pair. Pairs are
formed in buckets of about ``bucket`` documents of a source (a hash deals them, so
a source with a third of all rows is many buckets), each folded in one expression;
what is left of each bucket enters the next level of the reduction tree, until one
document a source is left, which is rounded by its probability. Randomness is a hash
of ids and a seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, new_names, row_hash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``sid, source, source_size, items, target`` from a table of ``source, source_size, items``.

    Sources in code point order (null last) get the weights in turn. Targets are in
    proportion to the weights, stop at ``most`` times the source's size, and the excess
    goes to the others by weight until none is above (water filling, in closed form:
    sources sorted by cap / weight, the level is the largest that fits). One row a source
    passes through one task: thousands of sources are fine, a source a document isn't.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)
    )
    named = named.withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    filled = (
        named.withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return filled.select("sid", "source", "source_size", "items", target.alias("target"))


_ITEM = "struct<h:bigint,id:{id},row:bigint,ord:bigint,size:bigint,base:bigint,p:double>"
_DONE = "struct<id:{id},row:bigint,ord:bigint,size:bigint,base:bigint,extra:bigint>"

#: One step of the fold: s holds the open document and the decided ones, x is the next document.
#: c: its random number, up / down: the words that can move to s.open from x, or from it to x.
_STEP = """
transform(array(named_struct(
    'c', pmod(xxhash64(s.open.h, x.h, {seed}), 9007199254740992L) / 9007199254740992D,
    'a', s.open.size, 'p', s.open.p, 'b', x.size, 'q', x.p,
    'up', least(s.open.size * (1 - s.open.p), x.size * x.p),
    'down', least(s.open.size * s.open.p, x.size * (1 - x.p)))),
  v -> if(v.c * (v.up + v.down) < v.down,
    if(v.a * (1 - v.p) <= v.b * v.q,
      {settle_open_1_keep_x},
      {settle_x_0_keep_open}),
    if(v.a * v.p <= v.b * (1 - v.q),
      {settle_open_0_keep_x},
      {settle_x_1_keep_open})))[0]
"""


def _fold(seed: int, id_type: str) -> Column:
    done = _DONE.format(id=id_type)
    item = _ITEM.format(id=id_type)

    def settle(who: str, extra: int, keep: str, p: str) -> str:
        new_p = f"greatest(0D, least(1D, {p}))"
        return (
            f"cast(named_struct('open', named_struct('h', {keep}.h, 'id', {keep}.id, 'row', {keep}.row, 'ord', {keep}.ord, 'size', {keep}.size, 'base', {keep}.base, 'p', {new_p}),"
            f" 'done', concat(s.done, array(named_struct('id', {who}.id, 'row', {who}.row, 'ord', {who}.ord, 'size', {who}.size, 'base', {who}.base, 'extra', {extra}L))))"
            f" as struct<open:{item},done:array<{done}>>)"
        )

    step = _STEP.format(
        seed=seed,
        settle_open_1_keep_x=settle("s.open", 1, "x", "v.q - v.a * (1 - v.p) / v.b"),
        settle_x_0_keep_open=settle("x", 0, "s.open", "v.p + v.b * v.q / v.a"),
        settle_open_0_keep_x=settle("s.open", 0, "x", "v.q + v.a * v.p / v.b"),
        settle_x_1_keep_open=settle("x", 1, "s.open", "v.p - v.b * (1 - v.q) / v.a"),
    )
    return F.expr(
        f"aggregate(slice(pool, 2, greatest(size(pool) - 1, 0)),"
        f" cast(named_struct('open', pool[0], 'done', array()) as struct<open:{item},done:array<{done}>>),"
        f" (s, x) -> {step})"
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42, bucket: int = 128) -> tuple[DataFrame, DataFrame]:
    """The mix: one row for each row of ``docs``, and the table of sources.

    First: ``id, row, ord, size, copies, sid`` - ``row`` is a hash of the row, ``ord``
    numbers rows that are equal. Second: see :func:`source_targets`.
    """
    rows = docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    id_type = docs.schema[id_col].dataType.simpleString()
    grouped = materialize(rows.groupBy("id", "row", "source", "size").count(), "mix-rows")
    sizes = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("count")).otherwise(0)).alias("items"))
    sources = materialize(source_targets(sizes, weights, share, most), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = (
        grouped.join(sources, grouped.source.eqNullSafe(sources.source))
        .select("sid", "id", "row", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))).alias("ord"), "items", rate.alias("rate"))
        .withColumn("base", F.floor("rate").cast("bigint"))
        .withColumn("p", F.col("rate") - F.col("base"))
    )
    certain = (F.col("p") == 0) | (F.col("size") == 0)
    parts = [items.where(certain).select("sid", "id", "row", "ord", "size", F.col("base").alias("copies"))]
    open_items = items.where(~certain).select("sid", "id", "row", "ord", "size", "base", "p", F.ceil(F.col("items") / bucket).cast("bigint").alias("buckets"))
    largest = sources.agg(F.max("items")).first()[0] or 0
    level = 0
    while True:
        h = F.xxhash64(F.lit(seed), F.lit(level), "id", "row", "ord")
        pool = F.expr("array_sort(collect_list(named_struct('h', h, 'id', id, 'row', row, 'ord', ord, 'size', size, 'base', base, 'p', p)), (l, r) -> case when l.size > r.size then -1 when l.size < r.size then 1 when l.h < r.h then -1 when l.h > r.h then 1 else 0 end)")
        folded = (
            open_items.withColumn("h", h)
            .withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
            .groupBy("sid", "bucket", "buckets")
            .agg(pool.alias("pool"))
            .select("sid", "buckets", _fold(seed + level, id_type).alias("s"))
        )
        folded = materialize(folded, f"mix-level{level}")
        parts.append(folded.select("sid", F.explode("s.done").alias("d")).select("sid", "d.id", "d.row", "d.ord", "d.size", (F.col("d.base") + F.col("d.extra")).alias("copies")))
        left = folded.select("sid", "s.open.id", "s.open.row", "s.open.ord", "s.open.size", "s.open.base", "s.open.p", F.ceil(F.col("buckets") / bucket).cast("bigint").alias("more"), F.col("buckets").alias("were"))
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "id", "row", "ord"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        parts.append(left.where("were = 1").select("sid", "id", "row", "ord", "size", (F.col("base") + (chance < F.col("p")).cast("bigint")).alias("copies")))
        largest = -(-largest // bucket)
        if largest <= 1:
            break
        open_items = left.where("were > 1").select("sid", "id", "row", "ord", "size", "base", "p", F.col("more").alias("buckets"))
        level += 1
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.union(part)
    return mixed, sources


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``id, size, source_size, target, taken, copies`` for every row of ``docs``.

    Null and empty texts have size 0 and take nothing. A null source is a source of
    its own, last in order. Null ids and repeated rows are documents like any other.
    An empty table gives an empty result.
    """
    mixed, sources = plan(docs, id_col, text_col, source_col, **options)
    return mixed.join(sources, "sid").select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, 0 to ``most`` times; same columns.

    Equal rows stand for one another: together they come as often as the mix takes them in all.
    Rows without words (null and empty texts) come as often as the whole part of their
    source's rate says, as they move no words. A null source is a source of its own; null ids are ids like others; an empty table stays empty. Columns of ``docs``
    may have any names.
    """
    mixed, _ = plan(docs, id_col, text_col, source_col, **options)
    own, copies, rows, again = new_names(docs, 4)
    totals = mixed.groupBy(F.col("row").alias(own)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    kept = docs.withColumn(own, row_hash(docs)).join(totals, own)
    once = kept.where(F.col(rows) == 1).union(kept.where(F.col(rows) > 1).dropDuplicates([own]))
    return once.withColumn(again, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
