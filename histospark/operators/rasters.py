"""Images as one row for each tile, whose pixels of all channels are one compressed array.

Rows of pixels are exchanged once, when they are packed; later steps exchange tiles or a few numbers
of an image. A tile's array is of doubles, channels first; ``state`` is NULL where every pixel
is there and has a value, else a byte for each: 0 no such row, 1 a NULL, 2 a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.operators import tiles
from histospark.runtime import stage_observed

RASTERS = "image_id bigint, n_rows int, n_cols int, tr int, tc int, channels array<int>, block binary, state binary"
NAMES = [x.split()[0] for x in RASTERS.split(", ")]
_KINDS = [pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.binary(), pa.binary()]
_PARTS = RASTERS + ", r0 int, c0 int, height int, width int"
#: Rows of pixels that are sent from Python at a time, about.
ROWS = 1 << 17


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpacked(block: bytes, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    n = int(np.prod(shape)) * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(block, n, codec="zstd", asbytes=True), kind).reshape(shape)


def packed(image: int, h: int, w: int, tr: int, tc: int, channels: list[int], a: np.ndarray, state: np.ndarray | None) -> tuple:
    """A row of RASTERS; values that aren't there count as 0."""
    whole = state is None or bool((state == 2).all())
    return image, h, w, tr, tc, channels, _packed(a), None if whole else _packed(state)


def table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), _KINDS)], NAMES)


def arrays(x: dict, height: int, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Values and state of a row of RASTERS, each of (channels, height, width)."""
    shape = len(x["channels"]), height, width
    return _unpacked(x["block"], np.float64, shape), None if x["state"] is None else _unpacked(x["state"], np.uint8, shape)


def is_rasters(df: DataFrame) -> bool:
    return "block" in df.columns


def rasters(df: DataFrame) -> DataFrame:
    """Pixels as RASTERS; they stay as they are if they are such already. Without ``channel`` all are of channel 1."""
    if is_rasters(df):
        return df
    channel = F.col("channel").cast("int") if "channel" in df.columns else F.lit(1)
    df = df.select(F.col("image_id").cast("bigint").alias("image_id"), "n_rows", "n_cols", "row", "col", channel.alias("channel"), F.col("value").cast("double").alias("value"))

    def run(group: pa.Table) -> pa.Table:
        image, h, w, tr, tc = (group[n][0].as_py() for n in NAMES[:5])
        (r0, r1), (c0, c1) = tiles.bounds(h, tr), tiles.bounds(w, tc)
        row, col, channel = (group[n].to_numpy() for n in ("row", "col", "channel"))
        null = group["value"].is_null().to_numpy()
        value = group["value"].fill_null(0.0).to_numpy()
        channels, k = np.unique(channel, return_inverse=True)
        a = np.zeros((len(channels), r1 - r0, c1 - c0))
        state = np.zeros(a.shape, np.uint8)
        a[k, row - 1 - r0, col - 1 - c0] = value
        state[k, row - 1 - r0, col - 1 - c0] = np.where(null, 1, 2)
        return table([packed(image, h, w, tr, tc, channels.tolist(), a, state)])

    return tiles.tiled(df).groupBy(*tiles.KEY).applyInArrow(run, RASTERS)


def one_tile() -> Column:
    return (F.col("n_rows") <= tiles.TILE) & (F.col("n_cols") <= tiles.TILE)


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rasters (written first) of images of one tile and of larger ones; None if there are none of those."""
    out, seen = stage_observed(rasters(df), largest=F.max(F.greatest("n_rows", "n_cols")))
    if (seen["largest"] or 0) <= tiles.TILE:
        return out, None
    return out.where(one_tile()), out.where(~one_tile())


def extent(x: dict, halo: int = 0) -> tuple[int, int, int, int]:
    """First and last (exclusive) row and column, from 0, of a tile with its halo."""
    return *tiles.bounds(x["n_rows"], x["tr"], halo), *tiles.bounds(x["n_cols"], x["tc"], halo)


def haloed(df: DataFrame, halo: int) -> DataFrame:
    """Rasters whose tiles hold their neighbours' pixels up to ``halo`` away. Tiles go to themselves and margins to neighbours."""
    names, kinds = [*NAMES, "r0", "c0", "height", "width"], [*_KINDS, *[pa.int32()] * 4]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                r0, r1, c0, c1 = extent(x)
                h, w = x["n_rows"], x["n_cols"]
                a, state = arrays(x, r1 - r0, c1 - c0)
                out = []
                for tr in range(max(0, x["tr"] - 1), min((h - 1) // tiles.TILE, x["tr"] + 1) + 1):
                    for tc in range(max(0, x["tc"] - 1), min((w - 1) // tiles.TILE, x["tc"] + 1) + 1):
                        (p, q), (s, t) = tiles.bounds(h, tr, halo), tiles.bounds(w, tc, halo)
                        p, q, s, t = max(p, r0), min(q, r1), max(s, c0), min(t, c1)
                        at = slice(None), slice(p - r0, q - r0), slice(s - c0, t - c0)
                        out.append((*packed(x["image_id"], h, w, tr, tc, x["channels"], a[at], None if state is None else state[at]), p, s, q - p, t - s))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    def run(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        x = parts[0]
        r0, r1, c0, c1 = extent(x, halo)
        channels = sorted({k for p in parts for k in p["channels"]})
        a = np.zeros((len(channels), r1 - r0, c1 - c0))
        state = np.zeros(a.shape, np.uint8)
        for p in parts:
            value, known = arrays(p, p["height"], p["width"])
            at = np.searchsorted(channels, p["channels"])[:, None, None], np.arange(p["height"])[:, None] + p["r0"] - r0, np.arange(p["width"]) + p["c0"] - c0
            a[at], state[at] = value, 2 if known is None else known
        return table([packed(*(x[n] for n in NAMES[:5]), channels, a, state)])

    return df.mapInArrow(send, _PARTS).groupBy(*tiles.KEY).applyInArrow(run, RASTERS)


def mapped(df: DataFrame, of: Callable[[dict], Iterator[list]], schema: str) -> DataFrame:
    """``of`` each row of ``df`` (RASTERS and more columns): iterators of the columns of batches, of which each may be one number for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k] for _, k in fields]
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time, for tiles are large once they are unpacked
                for columns in of(batch.slice(i, 1).to_pylist()[0]):
                    n = next(len(c) for c in columns if not np.isscalar(c) and c is not None)
                    whole = [pa.repeat(pa.scalar(c, k), n) if c is None or np.isscalar(c) else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays(whole, [name for name, _ in fields])

    fields = [x.split() for x in schema.split(", ")]
    return df.mapInArrow(run, schema)


PIXELS = "image_id bigint, n_rows int, n_cols int, row int, col int, channel int, value double"


def pixels(df: DataFrame) -> DataFrame:
    """Rasters as rows of pixels."""

    def of(x: dict) -> Iterator[list]:
        r0, r1, c0, c1 = extent(x)
        a, state = arrays(x, r1 - r0, c1 - c0)
        for k, channel in enumerate(x["channels"]):
            for i in range(0, r1 - r0, max(1, ROWS // (c1 - c0))):
                part = slice(i, i + max(1, ROWS // (c1 - c0)))
                yield from rows(x["image_id"], x["n_rows"], x["n_cols"], np.arange(r0, r1)[part] + 1, np.arange(c0, c1) + 1, channel, a[k, part], None if state is None else state[k, part], False)

    return mapped(df, of, PIXELS)


def rows(image: int, h: int, w: int, row: np.ndarray, col: np.ndarray, channel: int, a: np.ndarray, state: np.ndarray | None, dense: bool) -> Iterator[list]:
    """The columns of PIXELS of a part of an image; those that aren't there are left out, or NULL in a dense result."""
    r, c, v = np.repeat(row.astype(np.int32), len(col)), np.tile(col.astype(np.int32), len(row)), a.ravel()
    if state is None:
        out = pa.array(v)
    else:
        known = state.ravel()
        if not dense and not known.all():
            there = known > 0
            r, c, v, known = r[there], c[there], v[there], known[there]
        out = pa.array(v, mask=known < 2)
    if len(r):
        yield [image, h, w, r, c, channel, out]
