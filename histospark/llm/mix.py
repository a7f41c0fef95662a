"""Mixing sources to target shares of the corpus's tokens.

Each source's documents are encoded and packed, one after another, into blocks of BLOCK
token ids. A task packs the documents that it reads into pieces of BLOCK ids and counts
them; the counts of all tasks give each piece its place in its source, and a piece is cut
where a block of the source ends, so that ids are exchanged once, by source and block. The
mixture has as many tokens as the corpus. How many slots of a shard of SHARD slots go to each
source is drawn multinomially, given the sources' totals: the totals are split at the
nodes of a binary tree over the shards, so that any shard's counts, and where its slots
begin in each source, follow from a walk of logarithmic length and need no table. The draw
is exact at every size. Slot j of a source is block ``perm(j mod blocks)`` of its pass
``j div blocks``, perm being a pseudorandom permutation of its own; slots and blocks are then
joined by index. A source's last slot takes as many ids as its share still needs.

A source is used at most ``max_repeats`` times over; what it lacks is given to the other
sources in proportion to their targets.

Defined results: sources are compared without case and surrounding blanks; documents
without a source, or of one without a target, count towards the total but aren't used;
documents without tokens take no part; a source without documents gets no slots; target
shares are taken in proportion to their sum; NULL and non-positive shares and repeats take
nothing; repeated targets are added up; if all sources are used up before the total is
reached, the mixture is as much smaller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm import bpe
from histospark.runtime import stage

BLOCK = 1024
SHARD = 256
#: Sources that may be named; more are an error, since their table is collected.
MAX_SOURCES = 10_000
#: Whose the ids are: a document, its tokens from and to (exclusive), and their place in the piece.
_SPANS = "array<struct<doc_id: bigint, from_token: bigint, to_token: bigint, at: int>>"
#: Of a task and source: pieces from 0, and a row with ``piece`` -1 that has all its tokens and documents.
_PACKED = f"part int, source string, piece bigint, n_tokens bigint, n_documents bigint, ids array<int>, spans {_SPANS}"


@dataclass
class Source:
    name: str
    share: float
    repeats: int
    documents: int
    tokens: int
    blocks: int
    quota: int = 0
    slots: int = 0
    #: Tokens that the last slot takes.
    last: int = 0


def plain_source(c: str):
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def asked(targets: DataFrame) -> list[tuple[str, Fraction, int]]:
    """Name, share and repeats of every source with a target."""
    rows = targets.withColumn("source", plain_source("source")).where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = rows.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(Fraction(float(r.share)) for r in rows)
    return [(r.source, Fraction(float(r.share)) / total, int(r.repeats)) for r in rows]


@dataclass
class _Stream:
    """The ids of a source that a task has not yet put out, and their documents."""

    tokens: int = 0
    documents: int = 0
    ids: list[np.ndarray] = field(default_factory=list)
    held: int = 0
    #: Document, first token of it, and place of that in the stream, of the pieces held.
    spans: list[tuple[int, int, int]] = field(default_factory=list)


def packed(documents: DataFrame, names: list[str], path: str = bpe.VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Ids of the documents of ``names`` in pieces of ``block`` (_PACKED), written; others are counted only."""
    wanted, vocabulary = frozenset(names), bpe.read_vocabulary(documents.sparkSession, path)
    columns = [x.split()[0] for x in _PACKED.split(f" {_SPANS}")[0].split(", ")]

    def table(part: int, rows: list[tuple]) -> pa.RecordBatch:
        source, piece, n, docs, ids, spans = zip(*rows)
        offsets = lambda parts: pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32))
        flat = [s for p in spans for s in p]
        of_span = [pa.array([s[i] for s in flat], pa.int32() if i == 3 else pa.int64()) for i in range(4)]
        spans_ = pa.ListArray.from_arrays(offsets(spans), pa.StructArray.from_arrays(of_span, ["doc_id", "from_token", "to_token", "at"]))
        arrays = [pa.array(np.full(len(rows), part, np.int32)), pa.array(source, pa.string()), pa.array(piece, pa.int64()), pa.array(n, pa.int64()), pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets(ids), pa.array(np.concatenate(ids), pa.int32())), spans_]
        return pa.RecordBatch.from_arrays(arrays, columns)

    def cut(name: str, s: _Stream, upto: int) -> Iterator[tuple]:
        """Rows of the pieces that end at ``upto`` tokens held or before; the rest stays held."""
        flat = np.concatenate(s.ids) if s.ids else np.empty(0, np.int32)
        start, edges = s.tokens - s.held, [b for _, _, b in s.spans] + [s.tokens]
        k = 0
        for a in range(0, upto, block):
            b, spans = min(a + block, upto), []
            while k < len(s.spans) and edges[k] < start + b:
                doc, first, at = s.spans[k]
                low, high = max(at, start + a), min(edges[k + 1], start + b)
                spans.append((doc, first + low - at, first + high - at, low - start - a))
                if edges[k + 1] > start + b:
                    break
                k += 1
            yield name, (start + a) // block, b - a, 0, flat[a:b], spans
        s.ids, s.held, s.spans = [flat[upto:]], s.held - upto, s.spans[k:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, streams, part = bpe.encoder(vocabulary), {}, 0
        for batch in bpe.chunks(batches, 3):
            part = batch.column(0)[0].as_py()
            flat, offsets = coder.encode(batch.column(3).to_pylist())
            offsets = offsets.tolist()
            for i, (doc, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                known = source in wanted
                s = streams.setdefault(source if known else None, _Stream())
                n = offsets[i + 1] - offsets[i]
                s.documents += 1
                if n and known:
                    s.ids.append(flat[offsets[i] : offsets[i + 1]])
                    s.spans.append((doc, 0, s.tokens))
                    s.held += n
                s.tokens += n
            rows = [r for name, s in streams.items() if s.held >= block for r in cut(name, s, s.held // block * block)]
            for i in range(0, len(rows), 1000):
                yield table(part, rows[i : i + 1000])
        rest = [r for name, s in streams.items() for r in [*(cut(name, s, s.held) if s.held else ()), (name, -1, s.tokens, s.documents, np.empty(0, np.int32), [])]]
        for i in range(0, len(rest), 1000):
            yield table(part, rest[i : i + 1000])

    rows = documents.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("bigint"), plain_source(F.col("source").cast("string")), F.col("text").cast("string"))
    return stage(rows.mapInArrow(run, _PACKED))


def plan(pieces: DataFrame, sources: list[tuple[str, Fraction, int]], block: int = BLOCK, seed: int = 7) -> tuple[list[Source], int]:
    """Sources with their slots, and the tokens of the whole corpus; ``pieces`` is the result of ``packed``."""
    have = {r.source: r for r in pieces.where("piece < 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_documents").alias("documents")).collect()}  # MAX_SOURCES rows and one
    total = sum(int(r.tokens) for r in have.values())
    out = [Source(name, float(share), repeats, int(have[name].documents) if name in have else 0, n := int(have[name].tokens) if name in have else 0, -(-n // block)) for name, share, repeats in sources]
    # what capped sources lack goes to the rest, until no further source is capped
    left, open_, parts = Fraction(total), [(s, share) for s, (_, share, _) in zip(out, sources) if s.tokens], []
    while open_:
        shares = sum(share for _, share in open_)
        full = [s for s, share in open_ if left * share / shares >= s.tokens * s.repeats]
        if not full:
            parts = [(s, left * share / shares) for s, share in open_]
            break
        for s in full:
            s.quota = s.tokens * s.repeats
            left -= s.quota
        open_ = [(s, share) for s, share in open_ if s not in full]
    # whole tokens: the largest fractions are rounded up; a quota is below what its source can give
    for s, q in parts:
        s.quota = math.floor(q)
    over = int(left) - sum(s.quota for s, _ in parts)
    for s, _ in sorted(parts, key=lambda x: (x[0].quota - x[1], x[0].name))[:over]:
        s.quota += 1
    for i, s in enumerate(out):
        s.slots, s.last = _needed(i, s, block, seed)
    return out, total


def _needed(number: int, s: Source, block: int, seed: int) -> tuple[int, int]:
    """Slots that a source needs for its quota, and the tokens its last slot takes."""
    if not s.quota:
        return 0, 0
    passes, rest = divmod(s.quota, s.tokens)
    if not rest:
        passes, rest = passes - 1, s.tokens
    short = s.blocks * block - s.tokens
    # where in the last pass the one block comes that may be short
    at = int(permuted(np.array([s.blocks - 1]), s.blocks, _key(seed, number, passes), True)[0])
    given = lambda k: k * block - (short if at < k else 0)
    k = rest // block
    while given(k) < rest:
        k += 1
    return passes * s.blocks + k, rest - given(k - 1)


def blocks(pieces: DataFrame, sources: list[Source], block: int = BLOCK) -> DataFrame:
    """``source_no, block_index, ids, spans``: ``block`` ids of a source, fewer in its last block.

    The offsets of tasks are written, so that the planner knows their size: it broadcasts them if
    they are small, and else exchanges the pieces once more."""
    number = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s.name), F.lit(i))]) if sources else F.create_map(F.lit(""), F.lit(0))
    own = pieces.withColumn("source_no", F.element_at(number, F.col("source"))).where("source_no is not null")
    before = F.sum("n_tokens").over(Window.partitionBy("source_no").orderBy("part")) - F.col("n_tokens")
    offsets = stage(own.where("piece < 0").select(F.col("source_no").alias("_s"), F.col("part").alias("_p"), before.alias("_before")))
    placed = own.where("piece >= 0").join(offsets, (F.col("source_no") == F.col("_s")) & (F.col("part") == F.col("_p")))
    start = F.col("_before") + F.col("piece") * block
    placed = placed.select("source_no", "ids", "spans", F.floor(start / block).alias("block_index"), F.pmod(start, F.lit(block)).cast("int").alias("at"))
    # a piece lies in one block or, cut once, in two
    room = block - F.col("at")
    part = lambda low, high: F.filter(
        F.transform("spans", lambda s: F.struct(s["doc_id"].alias("doc_id"), (s["from_token"] + F.greatest(F.lit(0), low - s["at"])).alias("from_token"), F.least(s["to_token"], s["from_token"] + high - s["at"]).alias("to_token"))),
        lambda s: s["from_token"] < s["to_token"],
    )
    first = F.struct(F.col("block_index"), F.col("at"), F.slice("ids", F.lit(1), room).alias("ids"), part(F.lit(0), room).alias("spans"))
    second = F.struct((F.col("block_index") + 1).alias("block_index"), F.lit(0).alias("at"), F.slice("ids", room + 1, F.lit(block)).alias("ids"), part(room, F.lit(block)).alias("spans"))
    halves = F.when(F.size("ids") > room, F.array(first, second)).otherwise(F.array(first))
    cut = placed.select("source_no", F.explode(halves).alias("h")).select("source_no", "h.block_index", F.struct("h.at", "h.ids", "h.spans").alias("h"))
    # at most ``block`` parts of one id or more
    held = cut.groupBy("source_no", "block_index").agg(F.sort_array(F.collect_list("h")).alias("h"))
    return held.select("source_no", "block_index", F.flatten("h.ids").alias("ids"), F.flatten("h.spans").alias("spans"))


def _log_factorials(a: int, b: int) -> float:
    """log(a! / b!), precise also where both are large and near."""
    if max(a, b) < 10**6:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    if min(a, b) < 10**3:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    return (b + 0.5) * math.log1p(d / b) + d * (math.log(a) - 1) + (1 / a - 1 / b) / 12


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` items drawn without replacement are good, by ratio of uniforms: exact for any numbers."""
    total = good + bad
    g, m = min(good, bad), min(n, total - n)
    if not g or not m:
        z = 0
    else:
        mean = m * g / total
        # in whole numbers where they are exact, for all may be beyond what a double holds
        var = mean * ((total - g) / total) * ((total - m) / max(1, total - 1))
        mode = (m + 1) * (g + 1) // (total + 2)
        side, low, high = 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988, max(0, m - (total - g)), min(m, g)
        while True:
            x, y = rng.random(), rng.random()
            z = math.floor(mean + 0.5 + side * (y - 0.5) / x) if x else -1
            if low <= z <= high:
                near = _log_factorials(mode, z) + _log_factorials(g - mode, g - z) + _log_factorials(m - mode, m - z) + _log_factorials(total - g - m + mode, total - g - m + z)
                if 2 * math.log(x) <= near:
                    break
    if good > bad:
        z = m - z
    return good - z if m < n else z


class Shards:
    """Counts of the sources' slots in shards; what the walks have in common is drawn once."""

    def __init__(self, totals: list[int], size: int, seed: int) -> None:
        self.totals, self.size, self.seed, self.every = totals, size, seed, sum(totals)
        self.number = -(-self.every // size)
        self._drawn: dict[int, list[int]] = {}

    def _halved(self, node: int, counts: list[int], n: int) -> list[int]:
        """n of the items drawn without replacement, by kind."""
        if node not in self._drawn:
            if len(self._drawn) > 4096:
                self._drawn = {k: v for k, v in self._drawn.items() if k < 4096}
            rng = np.random.default_rng([self.seed, node])
            out, left, total = [], n, sum(counts)
            for c in counts:
                total -= c
                k = hypergeometric(c, total, left, rng)
                out.append(k)
                left -= k
            self._drawn[node] = out
        return self._drawn[node]

    def counts(self, shard: int) -> tuple[list[int], list[int]]:
        """Slots of each source in a shard and the slots of each before it."""
        low, high, here, before, node = 0, self.number, self.totals, [0] * len(self.totals), 1
        while high - low > 1:
            middle = (low + high) // 2
            left = self._halved(node, here, (middle - low) * self.size)
            if shard < middle:
                here, high, node = left, middle, 2 * node
            else:
                here, before, low, node = [a - b for a, b in zip(here, left)], [a + b for a, b in zip(before, left)], middle, 2 * node + 1
        return here, before


def _key(seed: int, source: int, repeat: int) -> int:
    return (seed * MAX_SOURCES + source) * 1_000_003 + repeat


def permuted(index: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(size), by a Feistel network and cycle walking."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def mixed(x: np.ndarray, r: int) -> np.ndarray:
        f = (x + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        return (((f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)) & mask

    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(3, -1, -1) if inverse else range(4):
            left, right = (right ^ mixed(left, r), left) if inverse else (right, left ^ mixed(right, r))
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def slots(spark: SparkSession, sources: list[Source], block: int = BLOCK, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """``shard, position, source_no, repeat, block_index, n_tokens`` of every slot of the mixture."""
    totals = [s.slots for s in sources]
    facts = [(s.blocks, s.slots, s.last, s.tokens - (s.blocks - 1) * block) for s in sources]
    schema = "shard bigint, position int, source_no int, repeat bigint, block_index bigint, n_tokens int"
    shards = -(-sum(totals) // shard)
    if not shards:
        return spark.createDataFrame([], schema)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Shards(totals, shard, seed)
        for frame in frames:
            for k in frame["id"].tolist():
                counts, before = tree.counts(k)
                parts = []
                for i, (n, b) in enumerate(zip(counts, before)):
                    if n:
                        held, all_, last, tail = facts[i]
                        slot = b + np.arange(n)
                        repeat, at = slot // held, np.empty(n, np.int64)
                        for r in np.unique(repeat):
                            at[repeat == r] = permuted(slot[repeat == r] % held, held, _key(seed, i, int(r)))
                        size = np.where(slot == all_ - 1, last, np.where(at == held - 1, tail, block))
                        parts.append(pd.DataFrame({"source_no": i, "repeat": repeat, "block_index": at, "n_tokens": size}))
                rows = pd.concat(parts, ignore_index=True)
                rows.insert(0, "position", permuted(np.arange(len(rows)), len(rows), seed + k))
                rows.insert(0, "shard", k)
                yield rows

    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, shards, 1, parts).mapInPandas(fill, schema)


def _named(rows: DataFrame, sources: list[Source]) -> DataFrame:
    names = F.array(*[F.lit(s.name) for s in sources]) if sources else F.array(F.lit(""))
    return rows.withColumn("source", F.get(names, F.col("source_no")))


def mixture(pieces: DataFrame, sources: list[Source]) -> DataFrame:
    """``shard, position, source, repeat, block_index, n_tokens, ids, spans`` of every slot; spans tell whose the ids are.

    Of a source's last slot, the spans tell of the whole block."""
    # the planner takes the slots for as few rows as there are shards and would broadcast them
    rows = slots(pieces.sparkSession, sources).hint("merge").join(blocks(pieces, sources), ["source_no", "block_index"])
    return _named(rows, sources).select("shard", "position", "source", "repeat", "block_index", "n_tokens", F.slice("ids", F.lit(1), F.col("n_tokens")).alias("ids"), "spans")


def report(spark: SparkSession, sources: list[Source], total: int) -> DataFrame:
    """Per source its target and actual share, and how often it was used, counted over all slots."""
    used = _named(slots(spark, sources), sources).groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.max(F.col("repeat") + 1).alias("most_repeats"))
    targets = spark.createDataFrame(
        [(s.name, s.share, s.repeats, s.documents, s.tokens, s.quota / total if total else 0.0) for s in sources], "source string, target_share double, max_repeats int, documents bigint, tokens bigint, planned_share double"
    )
    rows = targets.join(used, "source", "left").fillna(0, ["tokens_used", "most_repeats"])
    return rows.withColumns({"actual_share": F.coalesce(F.try_divide("tokens_used", F.sum("tokens_used").over(Window.partitionBy())), F.lit(0.0)), "corpus_tokens": F.lit(total).cast("bigint"), "mean_repeats": F.coalesce(F.try_divide("tokens_used", "tokens"), F.lit(0.0))})
