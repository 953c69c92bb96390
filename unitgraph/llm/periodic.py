"""Periodic runs of words: squares by Lempel-Ziv blocks and a suffix tree, located and merged into runs.

A run is a stretch of words of smallest period q that no neighbour extends. The method is
that of Gusfield and Stoye. Blocks of the Lempel-Ziv factorization give, by common
extensions at their borders, a set of squares that covers the leftmost occurrence of
every square; walks along suffix links complete it to the vocabulary of all squares; each
square's interval in the suffix array locates its occurrences, and neighbouring
occurrences of one period merge into a run. The suffix tree is held as the intervals of a suffix array.

Only stretches in which each four words came before within a short distance can hold a run
of a stated exponent; :func:`stretches` finds them all (a superset, by hashes), so that
plain prose never reaches the tree. Many texts share a tree: a separator of its own ends
each stretch, so no square crosses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of texts that are looked at together, and of stretches that share a tree (a longer text goes alone).
SLICE, TREE = 1 << 18, 1 << 17
#: Words in the grams by which stretches are found.
GRAM = 4
_FAR = np.int64(1) << 62


class SuffixTree:
    """Suffix tree of integers, the last of which comes once: intervals of the suffix array, inner nodes and leaves.

    Nodes are numbered; ``low``, ``high``, ``depth``, ``parent`` and ``link`` (the suffix link) are
    lists over inner nodes. Memory is some ``4 log2(n) + 200`` bytes a word.
    """

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        self.array, self.rank = self._sorted(text)
        self.text = text.tolist()
        self._lengths()
        self._nodes()

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and ranks by prefix doubling; groups of one are settled and leave."""
        n = self.n
        order = np.argsort(text, kind="stable")
        same = text[order[1:]] == text[order[:-1]]
        head = np.maximum.accumulate(np.where(np.concatenate(([False], same)), 0, np.arange(n)))
        rank = np.empty(n, np.int64)
        rank[order] = head
        active = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        k = 1
        while len(active):
            old, after = rank[active], np.minimum(active + k, n - 1)
            key = old * (n + 1) + np.where(active + k < n, rank[after] + 1, 0)
            order = np.argsort(key, kind="stable")
            active, key, old = active[order], key[order], old[order]
            at = np.arange(len(active))
            place = old + at - np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[active] = np.maximum.accumulate(np.where(new, place, 0))
            active = active[~(new & np.concatenate((new[1:], [True])))]
            k *= 2
        array = np.empty(n, np.int64)
        array[rank] = np.arange(n)
        return array, rank

    def _lengths(self) -> None:
        """Common prefixes of neighbours in the suffix array (Kasai's way, in order of the text), and a table of their minima."""
        n, text = self.n, self.text
        before = np.full(n, -1, np.int64)
        before[self.array[1:]] = self.array[:-1]
        found, same = [0] * n, 0
        for i, j in enumerate(before.tolist()):
            if j < 0:
                same = 0
                continue
            while text[i + same] == text[j + same]:
                same += 1
            found[i] = same
            if same:
                same -= 1
        lcp = np.zeros(n + 1, np.int32)
        lcp[:n] = np.array(found, np.int32)[self.array]
        levels = max(1, n.bit_length())
        self.minima = np.zeros((levels, n + 1), np.int32)
        self.minima[0] = lcp
        for j in range(1, levels):
            half = 1 << (j - 1)
            self.minima[j, : n + 1 - 2 * half + 1] = np.minimum(self.minima[j - 1, : n + 1 - 2 * half + 1], self.minima[j - 1, half : n + 2 - half])
        self.lcp = lcp
        self._log = np.zeros(n + 2, np.int8)
        for j in range(1, levels + 1):
            self._log[1 << j :] = j

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes ``i`` and ``j`` (different, from 0; ``n`` stands for the empty one)."""
        inside = (i < self.n) & (j < self.n)
        a, b = self.rank[np.where(inside, i, 0)], self.rank[np.where(inside, j, 0)]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = self._log[np.maximum(high - low + 1, 1)].astype(np.int64)
        low = np.minimum(low, self.n)
        found = np.minimum(self.minima[level, low], self.minima[level, np.maximum(high - (np.int64(1) << level) + 1, 0)])
        return np.where(inside, found, 0).astype(np.int64)

    def interval(self, rank: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share ``length`` words with that of ``rank``."""
        low, high = rank.copy(), rank.copy()
        for j in range(len(self.minima) - 1, -1, -1):
            step = np.int64(1) << j
            at = low - step + 1
            take = (at >= 1) & (self.minima[j, np.maximum(at, 0)] >= length)
            low = np.where(take, low - step, low)
            take = (high + step < self.n) & (self.minima[j, np.minimum(high + 1, self.n)] >= length)
            high = np.where(take, high + step, high)
        return low, high

    def _nodes(self) -> None:
        """Inner nodes: the intervals around each boundary in the suffix array; parents and suffix links by their intervals."""
        n, lcp = self.n, self.lcp.astype(np.int64)
        at = np.flatnonzero(lcp[1:n] > 0) + 1
        low, high = self.interval(at, lcp[at])
        key, first = np.unique(low * (n + 1) + high, return_index=True)
        low, high, depth = low[first], high[first], lcp[at[first]]
        # the parent's depth is the larger boundary of the interval
        above = np.maximum(lcp[low], lcp[high + 1])
        p_low, p_high = self.interval(low, above)
        parent = np.where(above > 0, np.searchsorted(key, p_low * (n + 1) + p_high), -1)
        after = self.rank[self.array[low] + 1] if len(low) else low
        l_low, l_high = self.interval(after, depth - 1)
        link = np.where(depth > 1, np.searchsorted(key, l_low * (n + 1) + l_high), -1)
        self.key, self.low, self.high, self.depth, self.parent, self.link = (x.tolist() for x in (key, low, high, depth, parent, link))
        leaf = np.maximum(lcp[:n], lcp[1 : n + 1])
        f_low, f_high = self.interval(np.arange(n), leaf)
        self.leaf_parent = np.where(leaf > 0, np.searchsorted(key, f_low * (n + 1) + f_high), -1).tolist()

    def node(self, low: int, high: int) -> int:
        """The inner node of an interval of more than one suffix."""
        return bisect_left(self.key, low * (self.n + 1) + high)

    def locus(self, node: int, rank: int, length: int) -> tuple[int, int, int]:
        """Where the first ``length`` words of suffix ``rank`` end: the highest node above ``node`` (-1: the leaf) that is as deep, and its interval."""
        depth, parent = self.depth, self.parent
        up = self.leaf_parent[rank] if node < 0 else parent[node]
        while up >= 0 and depth[up] >= length:
            node, up = up, parent[up]
        return (node, rank, rank) if node < 0 else (node, self.low[node], self.high[node])

    def child(self, low: int, high: int, offset: int, word: int) -> tuple[int, int] | None:
        """The part of an interval whose suffixes have ``word`` at ``offset``, or None."""
        array, text = self._array, self.text

        def first(value: int) -> int:
            a, b = low, high + 1
            while a < b:
                mid = (a + b) >> 1
                if text[array[mid] + offset] < value:
                    a = mid + 1
                else:
                    b = mid
            return a

        a = first(word)
        return None if a > high or text[array[a] + offset] != word else (a, first(word + 1) - 1)

    @property
    def _array(self) -> list[int]:
        if not hasattr(self, "_array_list"):
            self._array_list = self.array.tolist()
        return self._array_list


def blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest prefix of the rest that begins before it too, or one new word."""
    n = tree.n
    length, rank = tree.lcp.tolist(), tree.rank.tolist()
    # neighbours in the suffix array among the suffixes that begin earlier; those that begin later are taken out one by one
    left, right = list(range(-1, n)), list(range(1, n + 2))
    longest = [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, q, p = length[r], right[r], left[r]
        b = length[q] if q < n else 0
        longest[i] = a if a > b else b
        if q < n:
            length[q] = a if a < b else b
            left[q] = p
        if p >= 0:
            right[p] = q
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += longest[i] or 1
    return np.array(starts, np.int64)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``which, k``: each index as often as its count, and 1, 2, ... within it."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(1, len(which) + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def covering(tree: SuffixTree, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``start, period`` of squares with primitive roots of at most ``longest`` words.

    From each start, following squares of that period included, they cover the leftmost
    occurrence of every such square: it isn't inside one block, and its second half meets two blocks at most.
    """
    n, start = tree.n, blocks(tree)
    end = np.append(start[1:], n)
    size = end - start
    after = np.append(size[1:], 0)
    # squares that begin in a block and end behind it; squares that begin before a block and have their middle in it
    in_block, k_in = _counted(np.minimum(size, longest))
    before, k_before = _counted(np.minimum(size + after, longest))
    a = np.concatenate((end[in_block] - k_in, start[before]))
    b = np.concatenate((end[in_block], start[before] + k_before))
    k = np.concatenate((k_in, k_before))
    kept = (b < n) & (a > 0)
    a, b, k = a[kept], b[kept], k[kept]
    forward = np.minimum(tree.extension(a, b), k)
    least = np.maximum(k - forward, 1)

    def back(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        fits = a >= m
        return fits & (tree.extension(np.where(fits, a - m, 0), np.where(fits, b - m, 1)) >= m)

    kept = back(a, b, least)
    a, b, k, low = a[kept], b[kept], k[kept], least[kept]
    high = k.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = back(a, b, mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    found, period = a - low, k
    primitive, rest, prime = np.ones(len(k), bool), k.copy(), 2
    while len(rest) and prime * prime <= rest.max():
        divides = rest % prime == 0
        if divides.any():
            step = k // prime
            shorter = divides & (tree.extension(found, np.where(divides, found + step, found + 1)) >= 2 * k - step)
            primitive &= ~shorter
            while divides.any():
                rest = np.where(divides, rest // prime, rest)
                divides = rest % prime == 0
        prime += 1
    last = rest > 1
    step = np.where(last, k // np.maximum(rest, 1), 1)
    primitive &= ~(last & (tree.extension(found, found + step) >= 2 * k - step))
    pairs = np.unique(period[primitive] * n + found[primitive])
    return pairs % n, pairs // n


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``low, high, period``: the intervals of all squares, completed from covering ones by walks along suffix links.

    The next square of ``aw aw`` is ``wa wa``: the suffix link drops the first word, and the
    tree goes on with the same word or doesn't. A walk ends at a square that is known.
    """
    low, high = tree.interval(tree.rank[start], 2 * period)
    known: dict[tuple[int, int], int] = {}
    array, rank, text, depth, link = tree._array, tree.rank.tolist(), tree.text, tree.depth, tree.link
    for a, b, q in zip(low.tolist(), high.tolist(), period.tolist()):
        length = 2 * q
        node = -1 if a == b else tree.node(a, b)
        while (a, length) not in known:
            known[(a, length)] = b
            i = array[a]
            word, r = text[i], rank[i + 1]
            node, a, b = tree.locus(-1 if node < 0 else link[node], r, length - 1)
            if node < 0 or depth[node] >= length:
                if text[array[a] + length - 1] != word:
                    break
            else:
                part = tree.child(a, b, length - 1, word)
                if part is None:
                    break
                a, b = part
                node = -1 if a == b else tree.node(a, b)
    if not known:
        none = np.zeros(0, np.int64)
        return none, none, none
    keys = np.array(list(known), np.int64)
    return keys[:, 0], np.array(list(known.values()), np.int64), keys[:, 1] // 2


def runs_of(text: np.ndarray, longest: int, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of the runs of integers, the last of which comes once; periods up to ``longest``."""
    none = np.zeros(0, np.int64)
    if len(text) < 2 or longest < 1:
        return none, none, none
    tree = SuffixTree(text)
    low, high, period = vocabulary(tree, *covering(tree, longest))
    count = high - low + 1
    which, k = _counted(count)
    place = np.sort(period[which] * (tree.n + 1) + tree.array[low[which] + k - 1])
    if not len(place):
        return none, none, none
    first = np.concatenate(([True], np.diff(place) != 1))
    head = place[first]
    last = place[np.append(np.flatnonzero(first)[1:], len(place)) - 1]
    q, start = head // (tree.n + 1), head % (tree.n + 1)
    length = last - head + 2 * q
    kept = length >= np.maximum(min_length, min_exponent * q)
    return start[kept], length[kept], q[kept]


def _least_repeats(bound: int, min_length: int, min_exponent: int) -> int:
    """Grams that a run has, of those that came one period before, at least, for periods of more than half of ``bound`` up to it."""
    first = bound // 2 + 1 if bound > 1 else 1
    turn = min(max(min_length // min_exponent, first), bound)
    return min(max(min_length, min_exponent * q) - q - (GRAM - 1) for q in {first, turn, min(turn + 1, bound)})


def stretches(words: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Parts ``start, end`` of texts that hold all runs: of words (as hashes), and the text (0, 1, ...) that each is of.

    In a run of period q every gram but the first q came before, q words ago at most. For
    each power of two the stretches are marked in which that holds for as many grams
    in a row as a run of such a period has.
    """
    n = len(words)
    first = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
    stop = np.append(first[1:], n)
    if n < GRAM:
        return list(zip(first.tolist(), stop.tolist()))
    key = words[: n - GRAM + 1].copy()
    for k in range(1, GRAM):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : n - GRAM + 1 + k]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + text[: len(key)].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    distance = np.full(n, _FAR)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    whole = text[: n - GRAM + 1] == text[GRAM - 1 :]
    distance[: len(whole)][~whole] = _FAR
    longest = int((stop - first).max()) // min_exponent
    marks = np.zeros(n + 1, np.int64)
    bound = 1
    while bound < 2 * longest:
        need = _least_repeats(bound, min_length, min_exponent)
        if need <= 0:
            # runs so short have no gram that repeats: whole texts
            marks[first] += 1
            marks[stop] -= 1
        else:
            near = np.concatenate(([False], distance <= bound, [False]))
            edge = np.flatnonzero(near[1:] != near[:-1])
            a, b = edge[::2], edge[1::2]
            kept = b - a >= need
            a, b = a[kept], b[kept]
            own = np.searchsorted(first, a, "right") - 1
            np.add.at(marks, np.maximum(a - bound, first[own]), 1)
            np.add.at(marks, np.minimum(b + GRAM - 1, stop[own]), -1)
        bound *= 2
    inside = np.cumsum(marks[:n]) > 0
    owner = np.where(inside, text, -1)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [n]))
    return [(int(a), int(b)) for a, b in zip(edge[:-1], edge[1:]) if inside[a]]


def find_runs(texts: list[list[bytes]], min_length: int = 6, min_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs ``start, length, period`` of each list of words, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return found
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(sizes.sum())).view(np.uint64)
    owner, offset = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    parts = stretches(hashes, owner, min_length, min_exponent)
    at = 0
    while at < len(parts):
        group, total = [], 0
        while at < len(parts) and (not group or total + parts[at][1] - parts[at][0] <= TREE):
            group.append(parts[at])
            total += parts[at][1] - parts[at][0] + 1
            at += 1
        ids: dict[bytes, int] = {}
        coded, starts = [], []
        for k, (a, b) in enumerate(group):
            t = int(owner[a])
            own = int(offset[t])
            starts.append(len(coded))
            coded += [ids.setdefault(w, len(ids)) for w in texts[t][a - own : b - own]]
            coded.append(-1 - k)
        longest = max(b - a for a, b in group) // min_exponent
        start, length, period = runs_of(np.array(coded, np.int64), longest, min_length, min_exponent)
        which = np.searchsorted(starts, start, "right") - 1
        for s, n, q, k in zip(start.tolist(), length.tolist(), period.tolist(), which.tolist()):
            a = group[k][0]
            t = int(owner[a])
            found[t].append((s - starts[k] + a - int(offset[t]), n, q))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by spaces."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``id, runs, collapsed`` of each row: its runs (``start, length, period`` in words, by start, then period) and what is left of the text.

    Words are parted by space and the characters 9 to 13. A run has at least ``min_length``
    words and ``min_exponent`` (2 or more) periods. ``collapsed`` holds the words that no run
    covers behind its first period, joined by spaces. Null texts are empty ones, without
    runs; repeated rows and null ids are rows like others; other columns are left out. A text is held
    whole by its task, with its stretches that repeat in one tree (see :class:`SuffixTree`).
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                begin, texts, size = at, [], 0
                while at < batch.num_rows and size < SLICE:
                    texts.append(batch.column(1)[at].as_py().split())
                    size += len(texts[-1])
                    at += 1
                runs = find_runs(texts, min_length, min_exponent)
                left = [collapsed(t, r) for t, r in zip(texts, runs)]
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), pa.array(listed, shape), pa.array(left, pa.binary())], ["id", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text`` in which the end of a tenth of the texts is made periodic.

    With h the CRC-32 of the id as text and g a tenth of it: where 10 divides h, each of the n
    words from a = g % n on becomes the word of a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), and words
    are joined by spaces. Other texts, null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    chosen = F.col("h") % 10 == 0
    words = F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words").cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, n = F.col("a").cast("int"), F.col("p").cast("int"), F.col("n").cast("int")
    copies = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias(text_col))


def _most_repeated(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_runs``, the most repeated run (``start, length, period, exponent_milli``, null without runs), and digests of all runs and of the collapsed text."""
    rows = detect(docs, id_col, text_col, **options).withColumn("best", _most_repeated(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    return rows.select(
        F.col(f"`{id_col}`"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
