"""Preprocessing on the arrays of tiles: stain normalization, 3×3 mean, stretch and resampling, as the operators of rows have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.operators import rasters, tiles
from histospark.runtime import stage

#: Margin of tiles: one pixel for the mean, and one more of means for resampling.
HALO = 2
MOMENTS = "image_id bigint, channel int, n bigint, mean double, m2 double, lo double, hi double"


def moments(v: np.ndarray) -> tuple[int, float, float, float, float]:
    """Number, mean, sum of squares about it, and range; a NaN is the greatest value, as in Spark."""
    if not len(v):
        return 0, 0.0, 0.0, np.inf, -np.inf
    lo, hi = float(np.fmin.reduce(v)), float(v.max())
    mean = lo if lo == hi else float(v.mean())
    return len(v), mean, 0.0 if lo == hi else float(np.square(v - mean).sum()), lo, hi


def together(parts: list[tuple]) -> tuple[int, float, float, float, float]:
    """``moments`` of all from those of parts."""
    parts = [p for p in parts if p[0]]
    if not parts:
        return moments(np.empty(0))
    n, mean, m2, lo, hi = (np.array(x) for x in zip(*parts))
    least, most, total = float(np.fmin.reduce(lo)), float(hi.max()), int(n.sum())
    if least == most:
        return total, least, 0.0, least, most
    whole = float((n * mean).sum() / total)
    return total, whole, float(m2.sum() + (n * np.square(mean - whole)).sum()), least, most


def normalized(a: np.ndarray, state: np.ndarray | None, of: list[tuple]) -> tuple[np.ndarray, np.ndarray | None]:
    """Each channel at mean 0.5 and deviation 0.15, clamped; a NULL becomes 0 and NaN 1, as the comparisons of Spark have it."""
    a, state = a.copy(), None if state is None else state.copy()
    for k, (n, mean, m2, *_) in enumerate(of):
        sd = np.sqrt(m2 / (n - 1)) if n > 1 else 0.0
        if sd == 0:
            continue
        a[k] = np.fmin(np.maximum((a[k] - mean) / sd * 0.15 + 0.5, 0.0), 1.0)
        if state is not None:
            a[k][state[k] < 2] = 0.0
            state[k][state[k] == 1] = 2
    return a, state


def smoothed(a: np.ndarray, state: np.ndarray | None, r0: int, c0: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray | None]:
    """3×3 means inside the image; pixels next to an edge of the array that isn't the image's are wrong."""

    def box(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (1, 1), (1, 1)))
        x = x[:, :, :-2] + x[:, :, 1:-1] + x[:, :, 2:]
        return x[:, :-2] + x[:, 1:-1] + x[:, 2:]

    inner = tiles.inside(a.shape[1:], r0, c0, h, w, 1)
    if state is None:
        return np.where(inner, box(a) / 9, a), None
    known = state == 2
    some = box(known.astype(np.uint8)) > 0
    return np.where(inner, box(np.where(known, a, 0.0)) / 9, a), np.where(inner & (state > 0), np.where(some, 2, 1), state).astype(np.uint8)


def known(a: np.ndarray, state: np.ndarray | None) -> np.ndarray:
    return a.ravel() if state is None else a[state == 2]


def stretched(a: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return a if lo == hi or np.isnan(lo) else (a - lo) / (hi - lo)


def sides(n: int, scale: float, low: int, high: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New size of an axis, and of the targets whose first source is in ``low .. high`` (from 0): place, both sources, weight of the second.

    A source beyond the axis is -1."""
    size = max(1, round(n * scale))
    # the targets are in the order of their sources, and one more on each side is looked at for rounding
    start, stop = max(1, int((low + 0.5) * scale) - 1), min(size, int((high + 1.5) * scale) + 2)
    at = np.arange(1 if low == 0 else start, (size if high == n else stop) + 1)
    source = (at - 0.5) / scale + 0.5
    first = np.maximum(1, np.floor(source)).astype(np.int64)
    mine = (np.minimum(first, n) > low) & (np.minimum(first, n) <= high)
    at, source, first = at[mine], source[mine], first[mine]
    return size, at, np.where(first > n, -1, first - 1), np.minimum(n, first + 1) - 1, source - first


def resampled(x: dict, a: np.ndarray, state: np.ndarray | None, halo: int) -> Iterator[list]:
    """Rows of PIXELS of a tile at ``scale`` times its size, or as it is."""
    h, w, scale = x["n_rows"], x["n_cols"], x["scale"]
    r0, r1, c0, c1 = rasters.extent(x, halo)
    low, high, left, right = rasters.extent(x)
    if scale is None:
        for k, channel in enumerate(x["channels"]):
            for i in range(low, high, step := max(1, rasters.ROWS // (right - left))):
                part = slice(i - r0, min(i + step, high) - r0), slice(left - c0, right - c0)
                yield from rasters.rows(x["image_id"], h, w, np.arange(i, min(i + step, high)) + 1, np.arange(left, right) + 1, channel, a[k][part], None if state is None else state[k][part], False)
        return
    height, row, p, q, v = sides(h, scale, low, high)
    width, col, s, t, u = sides(w, scale, left, right)
    if not len(row) or not len(col):
        return
    beyond = (p < 0)[:, None] | (s < 0)
    p, q, s, t = np.maximum(p - r0, 0), q - r0, np.maximum(s - c0, 0), t - c0
    for k, channel in enumerate(x["channels"]):
        if state is not None and not (state[k] > 0).any():
            continue
        for i in range(0, len(row), step := max(1, rasters.ROWS // len(col))):
            at = slice(i, i + step)
            m = v[at][:, None]
            top, bottom = a[k][p[at]], a[k][q[at]]
            value = (1 - m) * (1 - u) * top[:, s] + (1 - m) * u * top[:, t] + m * (1 - u) * bottom[:, s] + m * u * bottom[:, t]
            lost = beyond[at]
            if state is not None:
                top, bottom = state[k][p[at]] < 2, state[k][q[at]] < 2
                lost = lost | top[:, s] | top[:, t] | bottom[:, s] | bottom[:, t]
            yield from rasters.rows(x["image_id"], height, width, row[at], col, channel, value, np.where(lost, 1, 2) if lost.any() else None, True)


def small(df: DataFrame, stain: bool, denoise: bool, stretch: bool) -> DataFrame:
    """Pixels of images of one tile (RASTERS with ``scale``), all steps at once."""

    def of(x: dict) -> Iterator[list]:
        h, w = x["n_rows"], x["n_cols"]
        a, state = rasters.arrays(x, h, w)
        with np.errstate(all="ignore"):
            if stain and max(x["channels"]) > 1:
                a, state = normalized(a, state, [moments(known(a[k], None if state is None else state[k])) for k in range(len(a))])
            if denoise:
                a, state = smoothed(a, state, 0, 0, h, w)
            if stretch:
                a = stretched(a, *moments(known(a, state))[3:])
            yield from resampled(x, a, state, 0)

    return rasters.mapped(df, of, rasters.PIXELS)


def _joined(df: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``, the ``moments`` of each of its images' channels by channel, from those of tiles."""
    fields = ["n", "mean", "m2", "lo", "hi"]

    def run(group: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for x in group.to_pylist():
            by.setdefault(x["channel"], []).append(tuple(x[f] for f in fields))
        found = [{"channel": k, **dict(zip(fields, together(v)))} for k, v in sorted(by.items())]
        kind = pa.list_(pa.struct([("channel", pa.int32()), ("n", pa.int64()), *[(f, pa.float64()) for f in fields[1:]]]))
        return pa.table([pa.array([group["image_id"][0].as_py()], pa.int64()), pa.array([found], kind)], ["_i", name])

    of_images = stage(parts.groupBy("image_id").applyInArrow(run, f"_i bigint, {name} array<struct<channel: int, n: bigint, mean: double, m2: double, lo: double, hi: double>>"))
    return df.join(of_images, F.col("image_id").eqNullSafe(F.col("_i"))).drop("_i")


def large(df: DataFrame, stain: bool, denoise: bool, stretch: bool) -> DataFrame:
    """Pixels of images of several tiles (RASTERS with ``scale``)."""
    scale = df.select("image_id", "scale").distinct().withColumnRenamed("image_id", "_i")
    df = stage(rasters.haloed(df, HALO)).join(stage(scale), F.col("image_id").eqNullSafe(F.col("_i"))).drop("_i")

    def core(x: dict, a: np.ndarray) -> np.ndarray:
        (r0, r1, c0, c1), (r2, _, c2, _) = rasters.extent(x), rasters.extent(x, HALO)
        return a[:, r0 - r2 : r1 - r2, c0 - c2 : c1 - c2]

    def until_smooth(x: dict) -> tuple[np.ndarray, np.ndarray | None]:
        r0, r1, c0, c1 = rasters.extent(x, HALO)
        a, state = rasters.arrays(x, r1 - r0, c1 - c0)
        if stain and max(s["channel"] for s in x["stains"]) > 1:
            by = {s["channel"]: tuple(s.values())[1:] for s in x["stains"]}
            a, state = normalized(a, state, [by[k] for k in x["channels"]])
        return smoothed(a, state, r0, c0, x["n_rows"], x["n_cols"]) if denoise else (a, state)

    def stats(of: str):
        def run(x: dict) -> Iterator[list]:
            r0, r1, c0, c1 = rasters.extent(x, HALO)
            with np.errstate(all="ignore"):
                a, state = until_smooth(x) if of == "smooth" else rasters.arrays(x, r1 - r0, c1 - c0)
                a, state = core(x, a), None if state is None else core(x, state)
                found = [moments(known(a[k], None if state is None else state[k])) for k in range(len(a))]
            yield [x["image_id"], *(np.array(c) for c in ([*x["channels"]], *zip(*found)))]

        return run

    def rest(x: dict) -> Iterator[list]:
        with np.errstate(all="ignore"):
            a, state = until_smooth(x)
            if stretch:
                a = stretched(a, *together([tuple(s.values())[1:] for s in x["limits"]])[3:])
            yield from resampled(x, a, state, HALO)

    if stain:
        df = _joined(df, rasters.mapped(df, stats("raw"), MOMENTS), "stains")
    if stretch:
        df = _joined(df, rasters.mapped(df, stats("smooth"), MOMENTS), "limits")
    return rasters.mapped(df, rest, rasters.PIXELS)
