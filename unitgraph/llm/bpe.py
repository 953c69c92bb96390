"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a string there is, for every prefix, exactly one token that can be the last of
the prefix's encoding. It is found left to right: a suffix automaton over the vocabulary
gives the tokens that end at the prefix's end, longest first, and the one that may follow
the last token of the prefix before it is stored. Two tokens may stand side by side if
merging the bytes of both gives back just these two; that test walks down the two merge
trees and asks whether a merge across the border would have come first. Following the
stored tokens back from the end gives the ids.

The text is first cut as the vocabulary file says: special tokens, then the byte-level
pattern. A piece of that pattern holds a space inside only in a run of white space, so
other texts are cut before every space first, the different parts of a batch of texts are
found by Arrow, and only these are cut by the pattern and looked up in a bounded table
of encodings. A long text is worked through in parts of about ``SLICE``
characters for the same reason, cut at spaces, line feeds and punctuation behind letters.

Memory: parts of ``SLICE``, tables of ``TABLE_BYTES`` for each of two generations, the
automaton (about 40 MB for 50,000 tokens), and one piece of the pattern.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers, and characters that are neither, by all versions of the character tables: behind one of
#: the first and before one of the second a piece of the pattern ends, and what begins there doesn't look back.
_LETTERS, _BREAKS = "0-9A-Za-zÀ-ÖØ-öø-ʯЀ-ԯぁ-ゖァ-ヺ一-龥가-힣", " \n\t\r,.;:?!()[]{}\"…—–、。，；：？！（）「」『』《》〈〉【】"
#: Where all versions of the character tables agree on letters, numbers and spaces; other texts are cut by the library.
_COMMON = r"[\u0000-ԯ‐-⁰₠-₰ぁ-ゖァ-ヺ一-龥가-힣]*"
#: Bytes that a generation of the table of pieces takes; there are two.
TABLE_BYTES = 64 << 20
#: Pairs of tokens remembered, at about 100 bytes each.
PAIRS = 100_000
#: Characters handled at once: lists of ids take many times the room of their text.
SLICE = 1 << 20


class SuffixAutomaton:
    """All substrings of a set of words, as states; a word is the longest string of its state.

    ``step[state << 8 | byte]`` is the next state, ``link`` the state of the longest suffix
    that stands in other places too, ``word`` the number of the word that a state is, or -1,
    and ``shorter`` the next state along the links that is a word, or -1.
    """

    def __init__(self, words: dict[int, bytes]):
        self.step: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        labels = [b""]  # the bytes that lead on from each state
        word = {}
        for number, raw in words.items():
            state = 0
            for byte in raw:
                state = self._extend(state, byte, labels)
            word[state] = number
        self.word = array("i", [-1]) * len(self.link)
        for state, number in word.items():
            self.word[state] = number
        self.shorter = array("i", [-1]) * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.shorter[state] = above if self.word[above] >= 0 else self.shorter[above]

    def _add(self, length: int, link: int, leads: bytes, labels: list[bytes]) -> int:
        self.length.append(length)
        self.link.append(link)
        labels.append(leads)
        return len(labels) - 1

    def _split(self, state: int, old: int, byte: int, labels: list[bytes]) -> int:
        """Take the strings that end in ``state`` + ``byte``, and their suffixes, out of ``old`` into a state of their own."""
        made = self._add(self.length[state] + 1, self.link[old], labels[old], labels)
        for b in labels[old]:
            self.step[made << 8 | b] = self.step[old << 8 | b]
        self.link[old] = made
        while state >= 0 and self.step.get(state << 8 | byte) == old:
            self.step[state << 8 | byte] = made
            state = self.link[state]
        return made

    def _extend(self, state: int, byte: int, labels: list[bytes]) -> int:
        """The state of the word so far with one more byte."""
        old = self.step.get(state << 8 | byte)
        if old is not None:
            return old if self.length[old] == self.length[state] + 1 else self._split(state, old, byte, labels)
        made = self._add(self.length[state] + 1, 0, b"", labels)
        while state >= 0 and (old := self.step.get(state << 8 | byte)) is None:
            self.step[state << 8 | byte] = made
            labels[state] += bytes((byte,))
            state = self.link[state]
        if state >= 0:
            self.link[made] = old if self.length[old] == self.length[state] + 1 else self._split(state, old, byte, labels)
        return made


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    table.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return table


class BytePairs:
    """Encoder and decoder for one ``tokenizers`` file of kind byte-level BPE."""

    def __init__(self, spec: str, pre_tokenizer=None):
        data = json.loads(spec)
        symbols = byte_symbols()
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        vocab = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()}
        #: left << 32 | right -> rank; for each token that a merge makes its rank, left and right
        self.merge: dict[int, int] = {}
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << 32 | right] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.spaced_specials = any(" " in t for t in self.special)
        self.pattern, self.common = regex.compile(PATTERN), regex.compile(_COMMON)
        self.odd_space = regex.compile(r"\s (?!\S)")
        self.pre_tokenizer = pre_tokenizer
        self.automaton = SuffixAutomaton({i: self.bytes_of[i] for i in sorted(vocab.values()) if self._stands(i)})
        self.pairs: dict[int, bool] = {}
        self.table: dict[str, bytes] = {}  # ids as 32-bit integers
        self.old_table: dict[str, bytes] = {}
        self.table_bytes = 0

    def _stands(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if self.rank[token] < 0:
            return len(self.bytes_of[token]) == 1
        return self._compatible(self.left[token], self.right[token], self.rank[token])

    def _compatible(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether no merge across the border of two tokens comes before those that make them (and before ``below``)."""
        while True:
            rank = self.merge.get(left << 32 | right)
            if rank is not None and rank < below:
                return False
            rank_l, rank_r = self.rank[left], self.rank[right]
            if rank_l < 0 and rank_r < 0:
                return True
            # undo the later of the two merges; at equal rank the left one was made first
            if rank_l > rank_r:
                below, left = rank_l, self.right[left]
            else:
                below, right = rank_r + 1, self.left[right]
                # a pair across the border of the same rank as the right token's merge stands further left, so it goes first

    def _new_pair(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._compatible(left, right)
        return known

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32-bit integers) of pieces: fill the last token of every prefix, then follow back.

        What holds for a prefix holds in every piece that begins with it, so of sorted pieces
        each takes over what it shares with the one before.
        """
        step, link, longest, word, shorter = self.automaton.step.get, self.automaton.link, self.automaton.length, self.automaton.word, self.automaton.shorter
        known, out, previous = self.pairs.get, [], b""
        # for each prefix: its last token, and the automaton's state and matched length
        last, states, matched = array("i", [-1]), array("i", [0]), array("i", [0])
        for raw in pieces:
            shared = 0
            for x, y in zip(raw, previous):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :], matched[shared + 1 :]
            state, length = states[shared], matched[shared]
            for end in range(shared + 1, len(raw) + 1):
                byte = raw[end - 1]
                while (to := step(state << 8 | byte)) is None and state:
                    state = link[state]
                    length = longest[state]
                state, length = (0, 0) if to is None else (to, length + 1)
                token, at = -1, state if word[state] >= 0 and longest[state] == length else shorter[state]
                while at >= 0:
                    token, size = word[at], longest[at]
                    if size == end:
                        break
                    before = last[end - size]
                    if before >= 0:
                        fits = known(before << 32 | token)
                        if self._new_pair(before, token) if fits is None else fits:
                            break
                    token, at = -1, shorter[at]
                last.append(token)
                states.append(state)
                matched.append(length)
            ids, at = array("i"), len(raw)
            while at:
                if last[at] < 0:
                    raise ValueError("a byte of the text has no token")
                ids.append(last[at])
                at -= len(self.bytes_of[last[at]])
            ids.reverse()
            out.append(ids.tobytes())
            previous = raw
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece, from the table or new; new ones are kept."""
        found, unknown = {}, []
        for piece in pieces:
            ids = self.table.get(piece) or self.old_table.get(piece)
            if ids is None:
                unknown.append(piece)
            else:
                found[piece] = ids
        unknown.sort()
        for piece, ids in zip(unknown, self.encode_pieces([p.encode() for p in unknown])):
            found[piece] = ids
            self._keep(piece, ids)
        return found

    def _keep(self, piece: str, ids: bytes) -> None:
        """Put a short piece, or part of a text of several pieces, into the table."""
        if len(piece) <= 48:
            if self.table_bytes > TABLE_BYTES:
                self.old_table, self.table, self.table_bytes = self.table, {}, 0
            self.table[piece] = ids
            self.table_bytes += 150 + len(piece) + len(ids)  # both objects and their place

    def pieces(self, text: str) -> list[str]:
        if self.pre_tokenizer is None or self.common.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                pieces = self.pieces(part)
                out += map(self.learn(set(pieces)).__getitem__, pieces)
        return b"".join(out)

    def plain(self, text: str) -> bool:
        """Whether the text may be cut before every space."""
        return not (self.odd_space.search(text) or self.special_pattern and self.special_pattern.search(text)) and (self.pre_tokenizer is None or self.common.fullmatch(text) is not None)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of many texts."""
        easy = [self.plain(t) for t in texts]
        words = pc.split_pattern(pa.array([t for t, e in zip(texts, easy) if e], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        parts = coded.indices.to_numpy().astype(np.int64)
        # the first part of a text has no space before it
        firsts = coded.take(pa.array(bounds[:-1])).to_pylist()
        chunks = [" " + word for word in coded.dictionary.to_pylist()]
        parts[bounds[:-1]] = np.arange(len(chunks), len(chunks) + len(firsts))
        chunks += firsts
        new, old = self.table.get, self.old_table.get
        packed = [new(c) or old(c) for c in chunks]
        cut = {k: self.pattern.findall(chunks[k]) for k, ids in enumerate(packed) if ids is None}
        found = self.learn({piece for pieces in cut.values() for piece in pieces})
        for k, pieces in cut.items():
            if len(pieces) == 1:
                packed[k] = found[pieces[0]]
            else:
                packed[k] = b"".join(map(found.__getitem__, pieces))
                self._keep(chunks[k], packed[k])
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = gather(np.frombuffer(b"".join(packed), np.int32), np.cumsum(sizes) - sizes, sizes, parts)
        ends = np.r_[0, np.cumsum(sizes[parts])][bounds]
        if not all(easy):
            done, pieces, k = [], [], 0
            for text, e in zip(texts, easy):
                if e:
                    pieces.append(ids[ends[k] : ends[k + 1]])
                    k += 1
                else:
                    pieces.append(np.frombuffer(self.encode_packed(text), np.int32))
                done.append(len(pieces[-1]))
            ids, ends = np.concatenate(pieces), np.r_[0, np.cumsum(done)]
        return ends, ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[starts[w] : starts[w] + sizes[w]]`` for each w of ``which``, one behind the other."""
    own = sizes[which]
    before = np.cumsum(own) - own
    return values[np.repeat(starts[which] - before, own) + np.arange(int(own.sum()))]


class Decoder:
    """Just the bytes of each id."""

    def __init__(self, spec: str):
        data, symbols = json.loads(spec), byte_symbols()
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in data["model"]["vocab"].items()}
        self.bytes_of.update({t["id"]: t["content"].encode() for t in data.get("added_tokens", [])})
        n = max(self.bytes_of) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def decode_batch(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of many lists of ids."""
        data = gather(self.values, self.starts, self.sizes, ids).tobytes()
        ends = np.r_[0, np.cumsum(self.sizes[ids])][offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids) -> str:
        """Text of a list of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict = {}


def load(path: str, kind=BytePairs):
    """The coder of a vocabulary file, once for each Python worker."""
    if (path, kind) not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        if kind is BytePairs:
            from tokenizers.pre_tokenizers import ByteLevel

            level = json.loads(spec)["pre_tokenizer"]
            _LOADED[path, kind] = BytePairs(spec, ByteLevel(add_prefix_space=level["add_prefix_space"], use_regex=level["use_regex"]))
        else:
            _LOADED[path, kind] = kind(spec)
    return _LOADED[path, kind]


def _with_column(df: DataFrame, name: str, kind: str, made) -> DataFrame:
    """``df`` with one more column, made batch by batch from ``made(batch) -> pa.Array``; the last input column is its input only."""
    kept = df.columns[:-1]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1]) + f", `{name}` {kind}"

    def run(batches):
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made(batch.column(batch.num_columns - 1))], [*kept, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` without ``text_col`` and with ``ids_col``: array<int>. Null is encoded as the empty text: no ids."""

    def ids_of(texts: pa.Array) -> pa.Array:
        offsets, ids = load(path).encode_batch([t or "" for t in texts.to_pylist()])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    others = [c for c in df.columns if c not in (text_col, ids_col)]
    return _with_column(df.select(*others, text_col), ids_col, "array<int>", ids_of)


def decode(df: DataFrame, ids_col: str, path: str, text_col: str = "decoded") -> DataFrame:
    """``df`` without ``ids_col`` and with ``text_col``, the text that the ids stand for. Null is decoded as no ids."""

    def text_of(ids: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        return pa.array(load(path, Decoder).decode_batch(np.r_[0, np.cumsum(sizes)], ids.flatten().to_numpy(zero_copy_only=False)), pa.string())

    others = [c for c in df.columns if c not in (ids_col, text_col)]
    return _with_column(df.select(*others, ids_col), text_col, "string", text_of)


def borders(special: Iterable[str] = ()) -> regex.Pattern:
    """Where a long text may be cut: before a space between letters or numbers, and before any of ``_BREAKS`` behind a letter, but for characters of special tokens."""
    breaks = "".join(regex.escape(c) for c in _BREAKS if not any(c in t for t in special))
    return regex.compile(rf"(?<=[\p{{L}}\p{{N}}])(?= [\p{{L}}\p{{N}}])" + (rf"|(?<=[{_LETTERS}])(?=[{breaks}])" if breaks else ""))


def parts(texts: list[str], most: int = SLICE, cuts: regex.Pattern = borders()) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of about ``most`` characters: the numbers of the texts in a group, and what it holds of each.

    A text longer than ``most`` is cut at one of ``cuts`` (:func:`borders`): a piece of the
    pattern begins there, whatever comes before. A text without any, such as one endless word, is one part.
    """
    numbers, group, held = [], [], 0
    for k, text in enumerate(texts):
        # as many characters as take the bytes of ``most`` simple ones
        at, room = 0, most if text.isascii() else max(1, most * len(text) // len(text.encode("utf-8", "replace")))
        while True:
            end = len(text)
            if end - at > room:
                cut = cuts.search(text, at + max(1, room // 2))
                end = cut.start() if cut else end
            numbers.append(k)
            group.append(text[at:end])
            held += (end - at) * most // room
            at = end
            if held >= most:
                yield numbers, group
                numbers, group, held = [], [], 0
            if at >= len(text):
                break
    if group:
        yield numbers, group


class Digests:
    """Digests of the encodings of texts, and of what these decode to; a long text is held in parts."""

    def __init__(self, path: str):
        self.coder, self.decoder = load(path), load(path, Decoder)
        self.cuts = borders(self.coder.special)
        shown = [f",{i}".encode() for i in range(len(self.decoder.sizes))]
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(shown), np.uint8)

    def of(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text, for each text."""
        counts = [0] * len(texts)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        whole = self.coder.spaced_specials  # no text may be cut at a space then
        for numbers, group in [(list(range(len(texts))), texts)] if whole else parts(texts, SLICE, self.cuts):
            offsets, ids = self.coder.encode_batch(group)
            digits = memoryview(gather(self.values, self.starts, self.sizes, ids))
            ends = np.r_[0, np.cumsum(self.sizes[ids])][offsets].tolist()
            decoded = self.decoder.decode_batch(offsets, ids)
            for j, (k, text, n) in enumerate(zip(numbers, decoded, np.diff(offsets).tolist())):
                hashes[k][0].update(digits[ends[j] + (counts[k] == 0 and n > 0) : ends[j + 1]])  # no comma before a text's first id
                hashes[k][1].update(text.encode())
                counts[k] += n
        return [(n, a.hexdigest(), b.hexdigest()) for n, (a, b) in zip(counts, hashes)]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``, null ids and repeated rows included.

    A null text is the empty text. Ids and decoded texts stay in the Arrow pass that makes
    them: only digests leave it. Other columns are ignored.
    """

    def run(batches):
        made = _LOADED.get((path, Digests)) or _LOADED.setdefault((path, Digests), Digests(path))
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                n, ids, decoded = zip(*made.of([t or "" for t in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
