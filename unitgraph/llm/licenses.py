"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that occur exactly once in
each: of these, a longest run in the same order (a longest increasing subsequence) are
the anchors, and the gaps between anchors are aligned the same way, with words that
are unique within the gap. A gap without anchors is finished by its common ends and
a longest common subsequence, found in linear space. Coverage is the share of the
template's words that found a partner.

Where to align: a stretch that covers ``threshold`` of a template must hold one of its
*seeds* - the rarest-looking words of the template, so many that they make up more than
``1 - threshold`` of its words. Stretches start around occurrences of seeds, so the
whole text is scanned, and a text without any seed is passed over with all it holds.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")

#: Public license notices and short grants.
TEMPLATES = {
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

#: Words too frequent to be seeds while others are left.
_COMMON = frozenset("a all an and any are as at be but by can for from have if in into is it its may means no not of on one or other out see shall so such that the this to under use was will with without work you your 0 1 2 3 4".split())


#: Words of the shortest run that can be a part of a match with insertions.
RUN = 6


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the words unique in both lists that form a longest chain in the same order."""
    in_a, in_b = Counter(a), Counter(b)
    at_b = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    pairs = [(i, at_b[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in at_b]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
        back[k] = ends[at - 1] if at else -1
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every prefix of ``b``."""
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (b == x)))
    return best


def _common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: halve ``a``, find where ``b`` must be cut for it, go on with both halves."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (a, b))
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, i2, j, j2 = todo.pop()
        if i == i2 or j == j2:
            continue
        if i2 - i == 1:
            found = np.flatnonzero(y[j:j2] == x[i])
            out += [(i, j + int(found[0]))] if len(found) else []
            continue
        middle = (i + i2) // 2
        cut = j + int(np.argmax(_row(x[i:middle], y[j:j2]) + _row(x[middle:i2][::-1], y[j:j2][::-1])[::-1]))
        todo += [(i, middle, j, cut), (middle, i2, cut, j2)]
    return sorted(out)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both lists, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        found = anchors(a[i:i2], b[j:j2])
        if not found:
            out += [(i + x, j + y) for x, y in _common_subsequence(a[i:i2], b[j:j2])]
            continue
        x, y = i, j
        for p, q in found:
            todo.append((x, i + p, y, j + q))
            out.append((i + p, j + q))
            x, y = i + p + 1, j + q + 1
        todo.append((x, i2, y, j2))
    return sorted(out)


@dataclass
class Template:
    name: str
    text: str
    threshold: float = 0.8
    tokens: list[str] = field(init=False)
    seeds: dict[str, list[int]] = field(init=False)

    def __post_init__(self):
        self.tokens = words(self.text)
        counts, places = Counter(self.tokens), {}
        for i, w in enumerate(self.tokens):
            places.setdefault(w, []).append(i)
        self.seeds, held = {}, 0
        for w in sorted(counts, key=lambda w: (w in _COMMON, counts[w], -len(w), w)):
            if held > (1 - self.threshold) * len(self.tokens) + 1e-9:
                break
            self.seeds[w] = places[w]
            held += counts[w]


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    matched: int
    start_word: int
    end_word: int


def _densest(pairs: list[tuple[int, int]], widest: int) -> list[tuple[int, int]]:
    """Most pairs that lie within ``widest`` words of text: partners far from the bulk are chance."""
    best, start = (0, 0), 0
    for end in range(len(pairs)):
        while pairs[end][0] - pairs[start][0] >= widest:
            start += 1
        if end + 1 - start > best[1] - best[0]:
            best = (start, end + 1)
    return pairs[best[0] : best[1]]


def _runs(tokens: list[str], template: Template, hits: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int, int]]:
    """``start in the text, start in the template, length`` of stretches of ``RUN`` or more equal words that hold a seed, by their start."""
    known, seen = template.tokens, {}
    found = []
    for p, s in hits:
        if not low <= p < high or p < seen.get(p - s, -1):
            continue
        a, b = p, s
        while a > low and b > 0 and tokens[a - 1] == known[b - 1]:
            a, b = a - 1, b - 1
        c, d = p + 1, s + 1
        while c < high and d < len(known) and tokens[c] == known[d]:
            c, d = c + 1, d + 1
        seen[p - s] = c
        if c - a >= RUN:
            found.append((a, b, c - a))
    return sorted(found)


def _chain(runs: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """The runs with most words of which each begins behind the one before, in the text and in the template."""
    # of each place in the template: the most words of chains that end there or before it, and the last run
    best: list[tuple[int, int]] = [(0, -1)] * (size + 1)

    def upto(at: int) -> tuple[int, int]:
        found = (0, -1)
        while at > 0:
            found, at = max(found, best[at]), at - (at & -at)
        return found

    back, ending = [-1] * len(runs), []
    for k, (p, s, n) in enumerate(runs):
        while ending and ending[0][0] <= p:  # runs that end before this one begins may come before it
            _, j, words_ = heapq.heappop(ending)
            at = runs[j][1] + runs[j][2]
            while at <= size:
                best[at] = max(best[at], (words_, j))
                at += at & -at
        before, back[k] = upto(s)
        heapq.heappush(ending, (p + n, k, before + n))
    last = max((upto(size), *((w, k) for _, k, w in ending)), default=(0, -1))[1]
    chain = []
    while last >= 0:
        chain.append(runs[last])
        last = back[last]
    return chain[::-1]


def _bridged(tokens: list[str], template: Template, hits: list[tuple[int, int]], low: int, high: int) -> Match | None:
    """A match whose parts stand in order with foreign words of any number between them.

    The parts are runs of equal words, chained as anchors are. Where text and template
    are of about one length between two runs, or before the first and behind the last, they are aligned.
    """
    size = len(template.tokens)
    chain = _chain(_runs(tokens, template, hits, low, high), size)
    if not chain or 2 * sum(n for _, _, n in chain) < template.threshold * size:
        return None
    pairs = [(p + k, s + k) for p, s, n in chain for k in range(n)]
    near = lambda n: n * 5 // 4 + 8
    first, last = chain[0], chain[-1]
    gaps = [(p + n, p2, s + n, s2) for (p, s, n), (p2, s2, _) in pairwise(chain)]
    gaps.append((max(low, first[0] - near(first[1])), first[0], 0, first[1]))
    end, rest = last[0] + last[2], last[1] + last[2]
    gaps.append((end, min(high, end + near(size - rest)), rest, size))
    for a, b, i, j in gaps:
        if i < j and b - a <= near(j - i):
            pairs += [(a + x, i + y) for x, y in align(tokens[a:b], template.tokens[i:j])]
        elif i < j:  # the missing words stand at one end of what is foreign
            left = align(tokens[a : a + near(j - i)], template.tokens[i:j])
            right = align(tokens[b - near(j - i) : b], template.tokens[i:j])
            pairs += [(a + x, i + y) for x, y in left] if len(left) >= len(right) else [(b - near(j - i) + x, i + y) for x, y in right]
    if len(pairs) < template.threshold * size - 1e-9:
        return None
    return Match(template.name, len(pairs) / size, len(pairs), min(p for p, _ in pairs), max(p for p, _ in pairs) + 1)


def scan_words(tokens: list[str], template: Template, places: dict[str, list[int]]) -> list[Match]:
    """All matches of one template, from left to right, none overlapping the one before; then, in what is left of the text, those with long insertions."""
    size = len(template.tokens)
    reach, widest = size // 2 + 8, size * 5 // 4 + 2
    hits = sorted((p, s) for w, at in template.seeds.items() for p in places.get(w, ()) for s in at)
    out, done, tried = [], 0, (-1, -1)
    for p, s in hits:
        if p < done:
            continue
        low, high = max(done, p - s - reach), min(len(tokens), p + (size - s) + reach)
        if (low, high) == tried:
            continue
        tried = (low, high)
        for cut in ((low, high), (max(low, p - s), min(high, p - s + size))):
            pairs = align(tokens[cut[0] : cut[1]], template.tokens)
            pairs = _densest(pairs, widest)
            if len(pairs) >= template.threshold * size - 1e-9:
                start, end = cut[0] + pairs[0][0], cut[0] + pairs[-1][0] + 1
                out.append(Match(template.name, len(pairs) / size, len(pairs), start, end))
                done = end
                break
    ends = [0, *(x for m in out for x in (m.start_word, m.end_word)), len(tokens)]
    for low, high in zip(ends[::2], ends[1::2]):
        while high - low >= template.threshold * size and (m := _bridged(tokens, template, hits, low, high)):
            out.append(m)
            low = m.end_word
    return out


def scan(text: str, templates: list[Template]) -> list[Match]:
    """Matches in a whole text. A short grant inside a longer template's match is left out."""
    low = text.lower()
    if not any(w in low for t in templates for w in t.seeds):
        return []
    tokens = WORD.findall(low)
    wanted = {w for t in templates for w in t.seeds}
    places: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found = [(m, len(t.tokens)) for t in templates for m in scan_words(tokens, t, places)]
    found.sort(key=lambda x: (-x[0].matched, x[0].start_word, x[0].license))
    kept: list[Match] = []
    for m, _ in found:
        if all(m.end_word <= k.start_word or m.start_word >= k.end_word for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m.start_word, m.license))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row for each license found: ``id, license, coverage, matched, start_word, end_word``.

    A match has ``threshold`` of a template's words, in order: either within 5/4 of its length, or as runs of
    ``RUN`` and more words, with what is changed between them, however many foreign words are inserted.
    Words are numbered from 0 over the whole text; ``end_word`` is the one behind the last.
    Null and empty texts have none; rows with null or repeated ids are scanned like others.
    Where matches overlap, the one with more matched words stays (ties: the earlier, then by name).
    """
    own = templates or TEMPLATES

    def run(batches):
        known = [Template(n, t, threshold) for n, t in own.items()]
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1)):
                for m in scan(text.as_py() or "", known):
                    at.append(k)
                    rows.append((m.license, m.coverage, m.matched, m.start_word, m.end_word))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["id", "license", "coverage", "matched", "start_word", "end_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, license string, coverage double, matched int, start_word int, end_word int").withColumnRenamed("id", id_col)
