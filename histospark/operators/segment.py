"""Segmentations composed of the other operators. Images without any foreground give no labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.operators import intensity, labeling, stencil
from histospark.operators.order import quantiles
from histospark.runtime import sized, stage

_AT = ["image_id", "n_rows", "n_cols", "row", "col"]


def channel(pixels: DataFrame, number: int, n_channels: int | None = None) -> DataFrame:
    """The pixels of one channel, from 1. The filter reaches the scan."""
    if number < 1 or (n_channels is not None and number > n_channels):
        raise ValueError(f"channel {number} is out of range")
    return pixels.where(F.col("channel") == number)


def crop(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Rows and columns of a rectangle (both ends inclusive) of every image, with places and sizes of their own; works on labels too."""
    if rows[0] < 1 or cols[0] < 1 or rows[1] < rows[0] or cols[1] < cols[0]:
        raise ValueError("a crop needs a first and a last row and column, from 1")
    df = pixels.where(F.col("row").between(*rows) & F.col("col").between(*cols))
    size = lambda c, ends: F.least(F.lit(ends[1]), c) - ends[0] + 1
    return df.withColumns({"row": F.col("row") - rows[0] + 1, "col": F.col("col") - cols[0] + 1, "n_rows": size(F.col("n_rows"), rows), "n_cols": size(F.col("n_cols"), cols)})


def cropped(images: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """``images`` after ``crop``: new sizes and no history."""
    size = lambda c, ends: F.greatest(F.lit(0), F.least(F.lit(ends[1]), c) - ends[0] + 1)
    return images.withColumns({"n_rows": size(F.col("n_rows"), rows), "n_cols": size(F.col("n_cols"), cols), "history": F.array().cast("array<string>")})


def binarize(pixels: DataFrame, method: str = "otsu", block_size: int = 51, offset: float = 0.05) -> DataFrame:
    """Dense ``on``: strictly above the channel's threshold, or its local mean less ``offset``."""
    if method == "adaptive":
        return stencil.adaptive(pixels, block_size, offset).select(*_AT, "on")
    if method not in ("otsu", "triangle"):
        raise ValueError(f"unknown threshold {method}")
    t = sized((intensity.otsu if method == "otsu" else intensity.triangle)(pixels).select(F.col("image_id").alias("_i"), "threshold"))
    return pixels.join(t, F.col("image_id") == F.col("_i")).select(*_AT, (F.col("value") > F.col("threshold")).cast("int").alias("on"))


def threshold(pixels: DataFrame, number: int = 1, method: str = "otsu", block_size: int = 51, offset: float = 0.05, open_size: int = 5, fill: bool = True, min_area: int = 50, max_area: int = 5000) -> DataFrame:
    """Threshold, opening, filled holes, components, and their areas' filter."""
    on = stencil.opening(binarize(channel(pixels, number), method, block_size, offset), open_size)
    if fill:
        sparse = labeling.fill_holes(stage(on))
    else:
        sparse = on.where("on = 1").select(*_AT)
    return labeling.filter_by_area(labeling.components(sparse), min_area, max_area)


def watershed(pixels: DataFrame, number: int = 1, seed_method: str = "h_minima", h: float = 0.05, min_distance: int = 10, expand_method: str = "voronoi", expand_pixels: int = 3) -> DataFrame:
    """Seeds from the distance to the foreground, grown over the whole image and then on.

    All seed methods are one, ``min_distance`` has no effect, and both ways of expansion are the
    same growth."""
    if seed_method not in ("h_minima", "distance", "markers") or expand_method not in ("voronoi", "dilation"):
        raise ValueError("unknown method")
    # the expansion goes on where the growth ends
    return labeling.grow(labeling.seeds(stage(binarize(channel(pixels, number))), h), None, more=max(0, expand_pixels))


def propagate(nuclei: DataFrame, membrane: DataFrame | None = None, lam: float = 0.01, expand_max: int = 20) -> DataFrame:
    """Nuclei grown for ``expand_max`` rounds, where the membrane's value is below its 90th percentile.

    ``lam`` must not be negative and has no further effect."""
    if lam < 0:
        raise ValueError("lambda must not be negative")
    allowed = None
    if membrane is not None:
        high = sized(quantiles(membrane, "image_id", F.col("value"), ["row", "col"], [0.9]).select(F.col("image_id").alias("_i"), F.col("q")[0].alias("_q")))
        allowed = membrane.join(high, F.col("image_id") == F.col("_i")).where("value < _q")
    return labeling.grow(nuclei, expand_max, allowed)
