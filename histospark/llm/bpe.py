"""Byte-level BPE of whole corpora with a public vocabulary, in numpy.

The vocabulary is a file of ranks (base64 token, rank); its path is a parameter. The driver
reads it and sends it along, so executors need no such file; each Python worker builds its
tables once. Words, as split by ``PATTERN``, are merged in
length-bucketed padded matrices: in each round every row merges its leftmost pair of
least rank, pairs being looked up in an open-addressing hash table, and the row is
compacted. Words are merged once per worker and looked up afterwards; lines that
occur again within a batch are looked up whole.

Defined results: a null or empty text gives an empty list; strings that look like
special tokens are ordinary text; every code point has ids, since all 256 bytes do;
repeated rows each get their own row; other columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary's texts are split before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
#: Widths of the matrices; longer words go through a heap.
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
MAX_WORDS, MAX_LINES = 200_000, 60_000
#: Characters encoded at a time, so that memory doesn't follow the batch.
CHUNK = 2_000_000

_words = regex.compile(PATTERN)
# the same for ASCII, which the standard engine splits faster
_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
# A time line in pieces that recur. They meet between a digit and a sign or before a
# blank, where no word of PATTERN reaches across.
_time = re.compile(r"(\s*+\d+:\d+)(:\d+)([.,]\d+)( -->)( \d+:\d+)(:\d+)([.,]\d+)", re.ASCII)
# A line with the blanks before it. Splitting after a non-blank and before a blank never
# cuts a word of PATTERN, and only blanks are looked ahead for, so lines encode alone.
_lines = regex.compile(r"\s*+\S(?:[^\n]*\S)?|\s+")


class Vocabulary:
    """Ranks and the hash table of all pairs whose concatenation is a token."""

    def __init__(self, text: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self._hash(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            slots = at[todo]
            free = self.keys[slots] < 0
            _, first = np.unique(slots[free], return_index=True)
            placed = todo[free][first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NO_RANK for none and where an id is negative."""
        keys = a.astype(np.int64) * self.size + b
        shape = keys.shape
        keys = keys.ravel()
        keys[(a.ravel() < 0) | (b.ravel() < 0)] = -2
        at = self._slot(keys)
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero(keys >= 0)
        for _ in range(self.probes):
            if not len(todo):
                break
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            at[todo] = (at[todo] + 1) & self.mask
        return out.reshape(shape)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(rows), max(1, (1 << 20) // width)):
                part = rows[k : k + max(1, (1 << 20) // width)]
                for i, ids in zip(part, self._merge_matrix([words[i] for i in part], width)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > low):
            out[i] = self._merge_long(words[i])
        return out

    def _merge_matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        # one more column than needed, so that compaction can read beyond the end
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width + 1), NO_RANK, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [np.empty(0, np.int32)] * n
        row = np.arange(n)
        while len(row):
            at = ranks.argmin(axis=1)
            line = np.arange(len(row))
            best = ranks[line, at]
            over = best == NO_RANK
            if over.any():
                for i in np.flatnonzero(over):
                    out[row[i]] = ids[i, : sizes[i]].copy()
                keep = ~over
                ids, ranks, sizes, row, at, best = ids[keep], ranks[keep], sizes[keep], row[keep], at[keep], best[keep]
                if not len(row):
                    break
                line = np.arange(len(row))
                most = int(sizes.max()) + 1
                ids, ranks = ids[:, :most], ranks[:, :most]
            columns = np.arange(ids.shape[1])
            source = np.minimum(columns + (columns > at[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            sizes = sizes - 1
            ids[line, at] = best
            ids[line, sizes] = -1
            ranks[line, sizes] = NO_RANK
            after = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[line, at] = np.where(at + 1 < sizes, self.pair_ranks(best, ids[line, after]), NO_RANK)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], best[before])
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges by a heap and a linked list, for words wider than any matrix."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        now = {i: r for i, r in enumerate(first) if r != NO_RANK}
        heap = [(r, i) for i, r in now.items()]
        heapq.heapify(heap)

        def look(i: int) -> None:
            j = after[i]
            key = ids[i] * self.size + ids[j] if j < n else -1
            rank = self._one(key)
            if rank is None:
                now.pop(i, None)
            else:
                now[i] = rank
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if now.get(i) != rank:
                continue
            j = after[i]
            now.pop(j, None)
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def _one(self, key: int) -> int | None:
        if key < 0:
            return None
        at = int((key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> int(self.shift))
        while (held := self.keys[at]) >= 0:
            if held == key:
                return int(self.values[at])
            at = (at + 1) & self.mask
        return None


class Encoder:
    """Texts to ids; keeps what it has merged, within bounds."""

    def __init__(self, text: bytes) -> None:
        self.vocabulary = Vocabulary(text)
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text."""
        split = [_lines.findall(t) if t else [] for t in texts]
        seen = Counter(x for lines in split for x in lines)
        known = self.lines
        parts, pieces = {}, set()
        for x in seen:
            if x in known:
                continue
            if "-->" in x and (m := _time.fullmatch(x)):
                parts[x] = m.groups()
                pieces.update(parts[x])
            else:
                parts[x] = (_ascii if x.isascii() else _words).findall(x)
        if len(self.words) > MAX_WORDS:
            self.words = {}
        made = {x: _ascii.findall(x) for x in pieces if x not in self.words}
        new = {w for x, words in parts.items() for w in words if w not in self.words} | {w for words in made.values() for w in words if w not in self.words}
        new = list(new - made.keys())
        for w, ids in zip(new, self.vocabulary.merge([w.encode() for w in new])):
            self.words[w] = ids.tobytes()
        for x, words in made.items():
            if len(words) > 1:
                self.words[x] = b"".join([self.words[w] for w in words])
            elif x not in self.words:
                self.words[x] = self.vocabulary.merge([x.encode()])[0].tobytes()
        word = self.words.__getitem__
        once = {x: b"".join(map(word, words)) for x, words in parts.items()}
        out = []
        for lines in split:
            out.append(b"".join([once[x] if x in once else known[x] for x in lines]))
        if len(known) > MAX_LINES:
            self.lines = {}
        self.lines.update((x, ids) for x, ids in once.items() if seen[x] > 1)
        flat = np.frombuffer(b"".join(out), np.int32)
        return flat, np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])])


_encoders: dict[int, Encoder] = {}


def read_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's file, some megabytes at most, for the workers."""
    with open(path, "rb") as f:
        text = f.read()
    return spark.sparkContext.broadcast((xxhash.xxh64_intdigest(text), text))


def encoder(vocabulary: Broadcast) -> Encoder:
    """This worker's encoder for a vocabulary."""
    key, text = vocabulary.value
    if key not in _encoders:
        _encoders[key] = Encoder(text)
    return _encoders[key]


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most about CHUNK bytes of column ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        piece = np.cumsum(sizes) // CHUNK
        for start, n in _ranges(piece):
            yield batch.slice(start, n)


def _ranges(piece: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(piece)]):
        yield int(a), int(b - a)


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every document."""
    vocabulary = read_vocabulary(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in chunks(batches, 1):
            flat, offsets = coder.encode(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")
