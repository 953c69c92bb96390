"""SimHash near-duplicates over a Gray-order hierarchical index.

1. Fingerprints: one Arrow pass; 64 majority bits over the hashes of word
   shingles. Only ``(id, fingerprint)`` leaves the pass.
2. Distinct fingerprints are dealt to *pigeonhole groups*: the 64 bits are cut
   into ``max_diff + shared`` blocks and two fingerprints that differ in at most
   ``max_diff`` bits agree on at least ``shared`` whole blocks. ``shared`` follows
   the number of fingerprints, so that a group of unrelated ones stays small.
   Groups beyond ``chunk`` rows (near copies crowd there) are cut into chunks,
   and every pair of chunks becomes a task of its own.
3. In a task, fingerprints are sorted by Gray rank, windows of neighbours become
   nodes holding the bit pattern that all their members share under a mask, and
   windows of nodes become upper nodes, up to one root for each group. A search
   runs down from the root, adds up the differences in the bits that each node
   fixes anew, and prunes the node with all below it when the sum exceeds
   ``max_diff``, or when all below it is already connected to the query. So a
   crowd of near copies yields a spanning forest, not all of its pairs.
4. The forests of all tasks are merged by distributed connected components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialize, new_names, row_hash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
FAN_OUT = 8
#: Pairs of queries and group members looked at in one vectorised step.
STEP = 1 << 20
#: Rows that a task of Spark gathers before it searches them.
HELD = 1 << 17


def fingerprint(text: bytes | None, words: int) -> int:
    """SimHash of a text; 0 if it has no words. Shingles are hashed in blocks, so memory stays bounded."""
    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ends = ends[words - 1 :] if len(tokens) > words else ends[-1:]
    total = len(ends)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 65536):
        s, e = starts[at : min(at + 65536, total)].tolist(), ends[at : at + 65536].tolist()
        hashes = np.fromiter([digest(joined[x:y], SEED) for x, y in zip(s, e)], np.uint64, len(s))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id_col, fp)``: a row for each row of ``docs``; ``fp`` is the fingerprint as a signed bigint."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over fingerprints sorted by (group, Gray rank); one root for each group.

    ``levels[0]`` are the fingerprints themselves. A node of level l covers the
    nodes ``first[l][i]:first[l][i + 1]`` of the level below. ``mask`` tells which
    bits all members share, ``fixed`` those that the node's parent doesn't share
    yet, ``pattern`` their values.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.fp = fp[self.order]
        g = group[self.order]
        every, some = [self.fp], [self.fp]
        self.first: list[np.ndarray] = [np.arange(len(g) + 1)]
        groups = [g]
        while True:
            g = groups[-1]
            new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
            if new.all():
                break
            begin = np.flatnonzero(new)
            place = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
            cut = np.flatnonzero(place % FAN_OUT == 0)
            self.first.append(np.r_[cut, len(g)])
            every.append(np.bitwise_and.reduceat(every[-1], cut))
            some.append(np.bitwise_or.reduceat(some[-1], cut))
            groups.append(g[cut])
        self.mask = [e | ~s for e, s in zip(every, some)]
        self.pattern = every
        self.fixed = list(self.mask)
        for low in range(len(self.mask) - 1):
            above = np.repeat(self.mask[low + 1], np.diff(self.first[low + 1]))
            self.fixed[low] = self.mask[low] & ~above
        #: for each level, the place after a node's last fingerprint
        self.end = [np.arange(1, len(fp) + 1)]
        for first in self.first[1:]:
            self.end.append(self.end[-1][first[1:] - 1])
        self.root = np.searchsorted(groups[-1], groups[0])
        self.size = np.diff(np.r_[np.flatnonzero(np.r_[True, groups[0][1:] != groups[0][:-1]]), len(fp)])[self.root] if len(fp) else np.zeros(0, int)

    def labels_above(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all of a node's members are in, or -1."""
        low, high = [label], [label]
        for first in self.first[1:]:
            low.append(np.minimum.reduceat(low[-1], first[:-1]))
            high.append(np.maximum.reduceat(high[-1], first[:-1]))
        return [np.where(a == b, a, -1) for a, b in zip(low, high)]

    def search(self, queries: np.ndarray, label: np.ndarray, above: list[np.ndarray], max_diff: int):
        """Pairs (query, later fingerprint of its group) within ``max_diff`` that are not in one component yet."""
        q, node = queries, self.root[queries]
        diff = np.bitwise_count((self.fp[q] ^ self.pattern[-1][node]) & self.mask[-1][node]).astype(np.int16)
        for level in range(len(self.first) - 1, -1, -1):
            keep = (diff <= max_diff) & (above[level][node] != label[q]) & (self.end[level][node] > q + 1)
            q, node, diff = q[keep], node[keep], diff[keep]
            if level == 0:
                later = node > q
                return q[later], node[later]
            first = self.first[level]
            n = first[node + 1] - first[node]
            q, diff = np.repeat(q, n), np.repeat(diff, n)
            node = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            diff = diff + np.bitwise_count((self.fp[q] ^ self.pattern[level - 1][node]) & self.fixed[level - 1][node])
        raise AssertionError("unreachable")


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge components along pairs; returns the new labels and the pairs of a spanning forest."""
    kept_a, kept_b = [], []
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            return label, np.concatenate(kept_a) if kept_a else a, np.concatenate(kept_b) if kept_b else b
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        order = np.lexsort((low, high))
        pick = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        kept_a.append(a[pick])
        kept_b.append(b[pick])
        parent = np.arange(len(label))
        parent[high[pick]] = low[pick]
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        label = parent[label]


def spanning_links(group: np.ndarray, fp: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints within ``max_diff`` bits that connect all that such pairs within a group connect."""
    if not len(fp):
        return fp, fp
    index = GrayIndex(group, fp)
    label = np.arange(len(fp))
    step = np.cumsum(index.size) // STEP
    out_a, out_b = [], []
    for queries in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(step)) + 1):
        a, b = index.search(queries, label, index.labels_above(label), max_diff)
        label, a, b = _union(label, a, b)
        out_a.append(index.fp[a])
        out_b.append(index.fp[b])
    return np.concatenate(out_a), np.concatenate(out_b)


def pigeonhole_keys(fp_col, max_diff: int, shared: int):
    """Array of bigint keys: one for each choice of ``shared`` out of ``max_diff + shared`` blocks of bits."""
    n = max_diff + shared
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    keys = []
    for k, chosen in enumerate(combinations(range(n), shared)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp_col.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def links(distinct: DataFrame, max_diff: int = 4, chunk: int = 512, shared: int | None = None) -> DataFrame:
    """``(a, b)``: links between values of the bigint column ``fp`` of distinct fingerprints.

    They connect exactly what all pairs within ``max_diff`` bits connect. A key
    collision only adds candidates, which are compared bit by bit all the same.
    """
    if shared is None:
        n, shared = distinct.count(), 1
        while shared < 4 and n >> (64 * shared // (max_diff + shared)) > 4 * chunk:
            shared += 1
    keyed = distinct.select("fp", F.explode(pigeonhole_keys(F.col("fp"), max_diff, shared)).alias("key"))
    sizes = keyed.groupBy("key").count()
    crowded = sizes.where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    dealt = keyed.join(sizes.where(f"count > 1 and count <= {chunk}").select("key"), "key", "left_semi").select(F.col("key").alias("task"), "fp")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    split = (
        keyed.join(crowded, "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("other != mine")
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "fp")
    )

    def found(tasks: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        a, b = spanning_links(np.concatenate(tasks), np.concatenate(fps).view(np.uint64), max_diff)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        """Searches whole tasks as they come by: what is held is ``HELD`` rows and one task."""
        tasks, fps, held = [], [], 0
        for batch in batches:
            task, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held >= HELD and len(task):
                # rows of the task that came last may go on
                going_on = int(np.searchsorted(task, tasks[-1][-1], side="right"))
                tasks.append(task[:going_on])
                fps.append(fp[:going_on])
                task, fp = task[going_on:], fp[going_on:]
                held += going_on
                if len(task):
                    yield found(tasks, fps)
                    tasks, fps, held = [], [], 0
            if len(task):
                tasks.append(task)
                fps.append(fp)
                held += len(task)
        if held:
            yield found(tasks, fps)

    return dealt.union(split).repartition("task").sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_diff: int = 4, chunk: int = 512) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: smallest id that
    links of at most ``max_diff`` differing bits reach, the row's own included.
    Null and empty texts, and texts without words, have fingerprint zero and are
    linked like any other. Rows with a null id are fingerprinted and linked, but
    give no component its name (``component_id`` is null if no row of a
    component has an id). Repeated rows come back as often as they came. Other
    columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    labels = components(links(distinct, max_diff, chunk)).select(F.col("node").alias("fp"), "root")
    nodes = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = nodes.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_diff: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id; rows with a null id stay.

    Rows are told apart by id and row hash: different texts of one id stand for
    themselves, of near copies with one id that of the smallest hash stays, of equal rows one.
    """
    mine, theirs, other, row, whole = new_names(docs, 5)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row_hash(docs).alias("row"))
    rows = docs.withColumn(mine, key)
    groups = near_duplicates(rows, mine, text_col, words, max_diff)
    gone = groups.where((F.col(mine) != F.col("component_id")) & ~F.col(f"{mine}.none")).select(F.col(f"{mine}.id").alias(theirs), F.col(f"{mine}.row").alias(other)).distinct()
    rest = rows.withColumn(row, F.col(f"{mine}.row")).join(gone, (F.col(row) == F.col(other)) & (F.col(id_col) == F.col(theirs)), "left_anti")
    named, unnamed = rest.where(F.col(id_col).isNotNull()), rest.where(F.col(id_col).isNull())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = named.groupBy(id_col, row).agg(F.first(F.struct(*columns)).alias(whole))
    return first.select(f"{whole}.*").union(unnamed.select(*columns))
