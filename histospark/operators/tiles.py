"""Work on square tiles of images, as arrays in Arrow batches.

A tile is ``TILE`` pixels a side, so what a task holds at a time doesn't follow the size of an
image; images that are no larger are one tile. Where the result of a pixel depends on others,
tiles are given a margin of their neighbours' pixels (a halo) or exchange their margins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512
KEY = ["image_id", "tr", "tc"]
LABELS = "image_id bigint, n_rows int, n_cols int, row int, col int, label int"


def tile_of(c: Column | str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c).cast("double") / TILE - 1 / TILE).cast("int")


def tiled(df: DataFrame, halo: int = 0) -> DataFrame:
    """Rows of pixels with their tile ``tr, tc``; with a halo, once for each tile that they are within or near."""
    for at, size, name in (("row", "n_rows", "tr"), ("col", "n_cols", "tc")):
        if not halo:
            df = df.withColumn(name, tile_of(at))
        else:
            low, high = tile_of(F.greatest(F.col(at) - halo, F.lit(1))), tile_of(F.least(F.col(at) + halo, F.col(size)))
            df = df.withColumn(name, F.explode(F.sequence(low, high)))
    return df


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy(zero_copy_only=False) for n in names]


def _frame(table: pa.Table) -> tuple[int, int, int, int, int]:
    """Image, size and tile of a group's rows."""
    return tuple(table[n][0].as_py() for n in ("image_id", "n_rows", "n_cols", "tr", "tc"))


def bounds(n: int, tile: int, halo: int = 0) -> tuple[int, int]:
    """First and last (exclusive) pixel, from 0, of a tile and its halo along an axis of n pixels."""
    return max(0, tile * TILE - halo), min(n, (tile + 1) * TILE + halo)


def stencil(df: DataFrame, value: str, halo: int, kind: str, of: Callable[[np.ndarray, int, int, int, int], np.ndarray]) -> DataFrame:
    """Dense rows whose ``value`` is made new by ``of(array, first row, first column, n_rows, n_cols)`` on tiles with a halo.

    Channels are worked on apart; other columns than the pixels' places are dropped."""
    more = [c for c in ("channel",) if c in df.columns]
    at = ["image_id", "n_rows", "n_cols", *more, "row", "col"]
    schema = "image_id bigint, " + ", ".join(f"{c} int" for c in at[1:]) + f", {value} {kind}"

    def run(table: pa.Table) -> pa.Table:
        image, h, w, tr, tc = _frame(table)
        (r0, r1), (c0, c1) = bounds(h, tr, halo), bounds(w, tc, halo)
        row, col, v = _numpy(table, "row", "col", value)
        a = np.zeros((r1 - r0, c1 - c0), v.dtype)
        a[row - 1 - r0, col - 1 - c0] = v
        out = of(a, r0, c0, h, w)
        (r2, r3), (c2, c3) = bounds(h, tr), bounds(w, tc)
        out = out[r2 - r0 : r3 - r0, c2 - c0 : c3 - c0]
        r, c = (x.ravel() for x in np.indices(out.shape))
        n = out.size
        same = [np.full(n, k, np.int32) for k in (h, w, *(table[m][0].as_py() for m in more))]
        columns = [np.full(n, image), *same, (r + r2 + 1).astype(np.int32), (c + c2 + 1).astype(np.int32), out.ravel()]
        return pa.table(dict(zip((*at, value), columns)))

    return tiled(df.select(*at, value), halo).groupBy(*KEY, *more).applyInArrow(run, schema)


def dense(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Every pixel of ``images`` (``image_id, n_rows, n_cols``) with its label, 0 for none.

    Only labelled pixels and a row for each tile are exchanged."""
    none = F.lit(None).cast("int")
    frames = images.select("image_id", "n_rows", "n_cols").distinct()
    frames = frames.withColumn("tr", F.explode(F.sequence(F.lit(0), tile_of("n_rows")))).withColumn("tc", F.explode(F.sequence(F.lit(0), tile_of("n_cols"))))
    rows = frames.select(*KEY, "n_rows", "n_cols", none.alias("row"), none.alias("col"), none.alias("label"))
    rows = rows.unionByName(tiled(labels).select(*KEY, none.alias("n_rows"), none.alias("n_cols"), "row", "col", "label"))

    def run(table: pa.Table) -> pa.Table:
        frame = table.filter(pc.is_valid(table["n_rows"]))
        if not frame.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), *[pa.int32()] * 5)], [x.split()[0] for x in LABELS.split(", ")])
        image, h, w, tr, tc = _frame(frame)
        (r0, r1), (c0, c1) = bounds(h, tr), bounds(w, tc)
        a = np.zeros((r1 - r0, c1 - c0), np.int32)
        row, col, label = _numpy(table.filter(pc.is_valid(table["row"])), "row", "col", "label")
        there = (row > r0) & (row <= r1) & (col > c0) & (col <= c1)
        a[row[there] - 1 - r0, col[there] - 1 - c0] = label[there]
        n = a.size
        r, c = (x.ravel().astype(np.int32) for x in np.indices(a.shape))
        columns = [np.full(n, image), np.full(n, h, np.int32), np.full(n, w, np.int32), r + np.int32(r0 + 1), c + np.int32(c0 + 1), a.ravel()]
        return pa.table(dict(zip((x.split()[0] for x in LABELS.split(", ")), columns)))

    return rows.groupBy(*KEY).applyInArrow(run, LABELS)


def extreme(a: np.ndarray, half: int, most: bool) -> np.ndarray:
    """Greatest or least value of the square around each pixel; pixels beyond the array don't count."""
    pick = np.maximum if most else np.minimum
    for axis in (0, 1):
        out = a.copy()
        for k in range(1, half + 1):
            low, high = [slice(None)] * 2, [slice(None)] * 2
            low[axis], high[axis] = slice(None, -k), slice(k, None)
            if a.shape[axis] > k:
                out[tuple(low)] = pick(out[tuple(low)], a[tuple(high)])
                out[tuple(high)] = pick(out[tuple(high)], a[tuple(low)])
        a = out
    return a


def inside(shape: tuple[int, int], r0: int, c0: int, h: int, w: int, half: int) -> np.ndarray:
    """Which pixels of a part of an image are farther than ``half`` from its edge."""
    r, c = np.arange(r0, r0 + shape[0]), np.arange(c0, c0 + shape[1])
    return ((r >= half) & (r < h - half))[:, None] & ((c >= half) & (c < w - half))


# runs and components


def runs_of(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the maximal runs of pixels, in the order of a scan by rows."""
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(col) != 1)])) if len(row) else np.empty(0, int)
    last = np.concatenate([new[1:], [len(row)]]) - 1 if len(row) else new
    return row[new], col[new], col[last]


def joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0..n-1 and edges u-v."""
    up = np.arange(n)
    while True:
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            return up
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def connected(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each run (in scan order) the first run of its 4-connected component."""
    n = len(row)
    wide = int(last.max(initial=0)) + 2
    row = row.astype(np.int64)
    low = np.searchsorted(row * wide + last, (row - 1) * wide + first, "left")
    high = np.searchsorted(row * wide + first, (row - 1) * wide + last, "right")
    count = np.maximum(0, high - low)
    here = np.repeat(np.arange(n), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return joined(n, here, above)


RUNS = "image_id bigint, n_rows int, n_cols int, tr int, tc int, row int, c0 int, c1 int, first bigint"


def component_runs(on: DataFrame) -> DataFrame:
    """Runs of the pixels of ``on`` within tiles; ``first`` is the least place in the scan of the tile's part of the component."""

    def run(table: pa.Table) -> pa.Table:
        image, h, w, tr, tc = _frame(table)
        row, c0, c1 = runs_of(*_numpy(table, "row", "col"))
        first = ((row.astype(np.int64) - 1) * w + c0 - 1)[connected(row, c0, c1)]
        n = len(row)
        whole = lambda v: np.full(n, v, np.int32)
        return pa.table({"image_id": np.full(n, image), "n_rows": whole(h), "n_cols": whole(w), "tr": whole(tr), "tc": whole(tc), "row": row, "c0": c0, "c1": c1, "first": first})

    return tiled(on.select("image_id", "n_rows", "n_cols", "row", "col")).groupBy(*KEY).applyInArrow(run, RUNS)


# growth


def spread(a: np.ndarray, rounds: int) -> np.ndarray:
    """``a`` after so many rounds in which each 0 takes the most frequent label among its 4 neighbours, of several the least.

    Labels are above 0; pixels below 0 take none."""
    wide = np.full((a.shape[0] + 2, a.shape[1] + 2), -1, a.dtype)
    wide[1:-1, 1:-1] = a
    flat, step = wide.ravel(), wide.shape[1]
    sides = (-step, step, -1, 1)
    new = np.flatnonzero(flat > 0)
    for _ in range(rounds):
        near = np.unique(np.concatenate([new + s for s in sides])) if len(new) else new
        near = near[flat[near] == 0]
        if not len(near):
            break
        v = np.stack([flat[near + s] for s in sides])
        votes = np.where(v > 0, (v[:, None] == v[None]).sum(axis=0), 0)
        flat[near] = np.where(votes == votes.max(axis=0), v, np.iinfo(a.dtype).max).min(axis=0)
        new = near
    return flat.reshape(wide.shape)[1:-1, 1:-1]


#: Rounds of growth between two exchanges of margins.
HALO = 64
BLOCKS = "image_id bigint, n_rows int, n_cols int, tr int, tc int, rounds int, block binary, changed boolean"
_PARTS = "image_id bigint, n_rows int, n_cols int, tr int, tc int, rounds int, r0 int, c0 int, height int, width int, block binary"


def _one(image: int, h: int, w: int, tr: int, tc: int, rounds: int, block: np.ndarray, changed: bool) -> pa.Table:
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.table([pa.array([v], k) for v, k in zip((image, h, w, tr, tc, rounds, block.tobytes(), changed), kinds)], names)


def blocks(labels: DataFrame, rounds: Column, allowed: DataFrame | None) -> DataFrame:
    """Tiles of all images of ``labels`` as arrays of int32: labels, 0 where one may grow, -1 where none may.

    An image of one tile is grown for all its ``rounds`` at once; ``rounds`` is what is left."""
    size = ["image_id", "n_rows", "n_cols"]
    frames = labels.select(*size).distinct().withColumn("rounds", rounds.cast("int"))
    frames = frames.withColumn("tr", F.explode(F.sequence(F.lit(0), tile_of("n_rows")))).withColumn("tc", F.explode(F.sequence(F.lit(0), tile_of("n_cols"))))
    none = F.lit(None).cast("int")
    rows = frames.select(*KEY, "n_rows", "n_cols", "rounds", none.alias("row"), none.alias("col"), none.alias("label"))
    rows = rows.unionByName(tiled(labels).select(*KEY, none.alias("n_rows"), none.alias("n_cols"), none.alias("rounds"), "row", "col", "label"))
    if allowed is not None:
        rows = rows.unionByName(tiled(allowed).select(*KEY, none.alias("n_rows"), none.alias("n_cols"), none.alias("rounds"), "row", "col", F.lit(0).alias("label")))
    free = -1 if allowed is not None else 0

    def run(table: pa.Table) -> pa.Table:
        frame = table.filter(pc.is_valid(table["n_rows"]))
        if not frame.num_rows:  # pixels of an image without labels
            return pa.table([pa.array([], k) for k in (pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.bool_())], [x.split()[0] for x in BLOCKS.split(", ")])
        (image, h, w, tr, tc), rounds = _frame(frame), frame["rounds"][0].as_py()
        (r0, r1), (c0, c1) = bounds(h, tr), bounds(w, tc)
        row, col, label = _numpy(table.filter(pc.is_valid(table["row"])), "row", "col", "label")
        there = (row > r0) & (row <= r1) & (col > c0) & (col <= c1)
        row, col, label = row[there] - 1 - r0, col[there] - 1 - c0, label[there]
        a = np.full((r1 - r0, c1 - c0), free, np.int32)
        a[row, col] = 0
        a[row[label > 0], col[label > 0]] = label[label > 0]
        if h <= TILE and w <= TILE:
            return _one(image, h, w, tr, tc, 0, spread(a, rounds), False)
        return _one(image, h, w, tr, tc, rounds, a, True)

    return rows.groupBy(*KEY).applyInArrow(run, BLOCKS)


def _array(block: bytes, h: int, w: int, tr: int, tc: int) -> tuple[np.ndarray, int, int]:
    (r0, r1), (c0, c1) = bounds(h, tr), bounds(w, tc)
    return np.frombuffer(block, np.int32).reshape(r1 - r0, c1 - c0), r0, c0


def grown(state: DataFrame) -> DataFrame:
    """``state`` (of ``blocks``) after at most HALO more rounds: exact, for a label comes one pixel far in a round."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 9, pa.binary()]
        names = [x.split()[0] for x in _PARTS.split(", ")]
        for batch in batches:
            for b in batch.to_pylist():
                h, w = b["n_rows"], b["n_cols"]
                a, r0, c0 = _array(b["block"], h, w, b["tr"], b["tc"])
                out = []
                for tr in range(max(0, b["tr"] - 1), min((h - 1) // TILE, b["tr"] + 1) + 1):
                    for tc in range(max(0, b["tc"] - 1), min((w - 1) // TILE, b["tc"] + 1) + 1):
                        (p, q), (s, t) = bounds(h, tr, HALO), bounds(w, tc, HALO)
                        r, c = max(p, r0), max(s, c0)
                        part = a[r - r0 : q - r0, c - c0 : t - c0]
                        out.append((b["image_id"], h, w, tr, tc, b["rounds"], r, c, *part.shape, part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    def run(table: pa.Table) -> pa.Table:
        image, h, w, tr, tc = _frame(table)
        (r0, r1), (c0, c1) = bounds(h, tr, HALO), bounds(w, tc, HALO)
        a = np.full((r1 - r0, c1 - c0), -1, np.int32)
        for p in table.select(["r0", "c0", "height", "width", "block"]).to_pylist():
            a[p["r0"] - r0 : p["r0"] - r0 + p["height"], p["c0"] - c0 : p["c0"] - c0 + p["width"]] = np.frombuffer(p["block"], np.int32).reshape(p["height"], p["width"])
        rounds = table["rounds"][0].as_py()
        (r2, r3), (c2, c3) = bounds(h, tr), bounds(w, tc)
        own = slice(r2 - r0, r3 - r0), slice(c2 - c0, c3 - c0)
        after = spread(a, min(HALO, rounds))
        return _one(image, h, w, tr, tc, max(0, rounds - HALO), np.ascontiguousarray(after[own]), bool((after[own] != a[own]).any()))

    parts = state.mapInArrow(send, _PARTS)
    return parts.groupBy(*KEY).applyInArrow(run, BLOCKS)


def labelled(state: DataFrame) -> DataFrame:
    """The labelled pixels of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                a, r0, c0 = _array(b["block"], b["n_rows"], b["n_cols"], b["tr"], b["tc"])
                r, c = np.nonzero(a > 0)
                n = len(r)
                columns = [np.full(n, b["image_id"]), np.full(n, b["n_rows"], np.int32), np.full(n, b["n_cols"], np.int32), (r + r0 + 1).astype(np.int32), (c + c0 + 1).astype(np.int32), a[r, c]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in LABELS.split(", ")])

    return state.mapInArrow(run, LABELS)
