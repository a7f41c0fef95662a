"""Neighbourhood operators as windows along rows and then along columns.

Windows are partitioned by image and row, or image and column, so a single large image
spreads over many tasks. ``pixels`` are dense unless said otherwise. A NULL value is left
out of sums, as in any aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from histospark.operators import tiles


def keys(df: DataFrame) -> list[str]:
    return ["image_id", *(c for c in ("channel",) if c in df.columns)]


def along_row(df: DataFrame) -> WindowSpec:
    return Window.partitionBy(*keys(df), "row").orderBy("col")


def along_col(df: DataFrame) -> WindowSpec:
    return Window.partitionBy(*keys(df), "col").orderBy("row")


def interior(half: int) -> Column:
    return (F.col("row") > half) & (F.col("row") <= F.col("n_rows") - half) & (F.col("col") > half) & (F.col("col") <= F.col("n_cols") - half)


def _box(df: DataFrame, value: str, half: int, fn, out: str) -> DataFrame:
    df = df.withColumn(out, fn(F.col(value)).over(along_row(df).rowsBetween(-half, half)))
    return df.withColumn(out, fn(F.col(out)).over(along_col(df).rowsBetween(-half, half)))


def integral(df: DataFrame, value: str = "value", out: str = "integral") -> DataFrame:
    """Sum of all pixels above and to the left, inclusive."""
    df = df.withColumn(out, F.sum(value).over(along_row(df).rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(out, F.sum(out).over(along_col(df).rowsBetween(Window.unboundedPreceding, 0)))


def mean3(df: DataFrame, value: str = "value") -> DataFrame:
    """3×3 mean inside; the outer ring keeps its values."""
    out = _box(df, value, 1, F.sum, "_mean")
    return out.withColumn(value, F.when(interior(1), F.col("_mean") / 9).otherwise(F.col(value))).drop("_mean")


def adaptive(df: DataFrame, block_size: int = 51, offset: float = 0.05, value: str = "value") -> DataFrame:
    """``on``: 1 where the value exceeds its local mean less ``offset``; a NULL value is off.

    The mean divides by the whole block also near edges; an even size counts as the next odd.
    Differences below 1e-12 count as none, so that summation order can't decide. Tiles have a halo
    of half a block, and sums of blocks are differences of running sums."""
    half = block_size // 2
    size = 2 * half + 1

    def of(a: np.ndarray, r0: int, c0: int, h: int, w: int) -> np.ndarray:
        run = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
        run[1:, 1:] = np.nan_to_num(a).cumsum(axis=0).cumsum(axis=1)
        (top, bottom), (left, right) = ((np.maximum(k - half, 0), np.minimum(k + half + 1, n)) for n in a.shape for k in [np.arange(n)])
        total = run[bottom][:, right] - run[top][:, right] - run[bottom][:, left] + run[top][:, left]
        return (a - (total / (size * size) - offset) > 1e-12).astype(float)

    out = tiles.stencil(df.withColumn(value, F.col(value).cast("double")), value, half, "double", of)
    return out.withColumn("on", F.col(value).cast("int")).drop(value)


def erode(df: DataFrame, size: int) -> DataFrame:
    """``on`` where all of the square is on; the outer ring of half its side is off."""
    half = size // 2
    return _box(df, "on", half, F.min, "_on").withColumn("on", F.when(interior(half), F.col("_on")).otherwise(0)).drop("_on")


def dilate(df: DataFrame, size: int) -> DataFrame:
    """``on`` where any of the square is on; the outer ring of half its side is off."""
    half = size // 2
    return _box(df, "on", half, F.max, "_on").withColumn("on", F.when(interior(half), F.col("_on")).otherwise(0)).drop("_on")


def opening(df: DataFrame, size: int = 5) -> DataFrame:
    """Erosion and then dilation, both on the same tiles, whose halo reaches as far as the two together."""
    if size <= 0:
        return df
    half = size // 2

    def of(a: np.ndarray, r0: int, c0: int, h: int, w: int) -> np.ndarray:
        ring = tiles.inside(a.shape, r0, c0, h, w, half)
        return np.where(ring, tiles.extreme(np.where(ring, tiles.extreme(a, half, False), 0), half, True), 0).astype(np.int32)

    return tiles.stencil(df, "on", 2 * half, "int", of)


def neighbours(labels: DataFrame) -> DataFrame:
    """``labels`` (sparse) with ``n_same``, the number of 4-neighbours of the same label.

    A label's pixel and its neighbour agree if the next row of the window is the next pixel."""
    row, col = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    same = []
    for w, c in ((row, "col"), (col, "row")):
        for step, shift in ((F.lag, 1), (F.lead, -1)):
            same.append(F.coalesce(((step(c).over(w) + shift == F.col(c)) & (step("label").over(w) == F.col("label"))).cast("int"), F.lit(0)))
    return labels.withColumn("n_same", same[0] + same[1] + same[2] + same[3])


def border(labels: DataFrame) -> DataFrame:
    """``labels`` with ``is_border``: on the image's edge, or a 4-neighbour of another label or none."""
    return neighbours(labels).withColumn("is_border", F.col("n_same") < 4).drop("n_same")


def on_edge() -> Column:
    return (F.col("row") == 1) | (F.col("col") == 1) | (F.col("row") == F.col("n_rows")) | (F.col("col") == F.col("n_cols"))
