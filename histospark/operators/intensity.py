"""Intensity and colour transforms. A constant channel stays as it is, unless stated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators import prepare, rasters
from histospark.operators.order import quantiles
from histospark.operators.resample import scaled
from histospark.operators.stencil import keys
from histospark.runtime import over, sized

BINS = 256
#: The Ruifrok and Johnston stain vectors, a row each.
RUIFROK = ((0.6500286, 0.7040055, 0.2859569), (0.2681468, 0.5688969, 0.7782507), (0.7110272, 0.4232710, 0.5615109))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def optical_density(c: Column) -> Column:
    return -F.log(F.least(F.greatest(c, F.lit(1e-6)), F.lit(1.0)))


def _stats(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of its groups, which are computed first and joined: no group is held in one task."""
    totals = sized(df.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(*[c.alias(k) for k, c in aggregates.items()]))
    on = [F.col(k) == F.col(f"_{k}") for k in by]
    return df.join(totals, on).drop(*[f"_{k}" for k in by])


def normalize(df: DataFrame) -> DataFrame:
    """Each channel stretched to 0..1 by its own range."""
    return _stretched(df, keys(df))


def contrast_stretch(df: DataFrame) -> DataFrame:
    """All channels stretched to 0..1 by their common range."""
    return _stretched(df, ["image_id"])


def _stretched(df: DataFrame, by: list[str]) -> DataFrame:
    df = _stats(df, by, _lo=F.min("value"), _hi=F.max("value"))
    flat = F.col("_hi") == F.col("_lo")
    return df.withColumn("value", F.when(flat, F.col("value")).otherwise(over(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def reinhard(df: DataFrame) -> DataFrame:
    """Each channel brought to mean 0.5 and deviation 0.15 and clamped; images of one channel stay."""
    df = _stats(df, keys(df), _mean=F.avg("value"), _sd=F.stddev_samp("value"))
    df = _stats(df, ["image_id"], _channels=F.max("channel"))
    scaled = F.when(F.col("_sd") > 0, over(F.col("value") - F.col("_mean"), F.col("_sd")) * 0.15 + 0.5).otherwise(F.col("value"))
    return df.withColumn("value", F.when(F.col("_channels") > 1, clamp(scaled)).otherwise(F.col("value"))).drop("_mean", "_sd", "_channels")


STAIN_METHODS = ("reinhard", "macenko", "vahadane")


def stain_normalize(df: DataFrame, method: str = "reinhard") -> DataFrame:
    """Every method, also macenko and vahadane, is the channel-wise normalization."""
    if method not in STAIN_METHODS:
        raise ValueError(f"unknown stain normalization {method}")
    return reinhard(df)


def equalize(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Histogram equalization of each whole channel: no tiles and no clip limit."""
    by = keys(df)
    df = _stats(df, by, _lo=F.min("value"), _hi=F.max("value"))
    scaled = over(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    df = df.withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(scaled * bins) + 1, F.lit(bins))))
    counts = df.where("_bin is not null").groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    up = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    # the first of the bins may be empty only if it holds no minimum, which it does: the least sum is the first bin's
    cdf = counts.withColumn("_cum", up)
    ends = Window.partitionBy(*by)
    cdf = cdf.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_bin").alias("_b"), over(F.col("_cum") - F.min("_cum").over(ends), (F.max("_cum").over(ends) - F.min("_cum").over(ends)).cast("double")).alias("_cdf"))
    on = [F.col(k) == F.col(f"_{k}") for k in by] + [F.col("_bin") == F.col("_b")]
    return df.join(sized(cdf), on, "left").withColumn("value", F.coalesce("_cdf", "value")).drop("_lo", "_hi", "_bin", "_b", "_cdf", *[f"_{k}" for k in by])


def histogram(df: DataFrame, bins: int = BINS) -> DataFrame:
    """``bin, n, mid`` of every channel: equal bins closed on the right, the first also on the left.

    Only finite values count; values within 1e-7 of a bin above its edge belong to the bin below;
    a constant channel has all in bin 1, whose middle is the constant."""
    by = keys(df)
    value = F.col("value")
    df = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    df = _stats(df, by, _lo=F.min("value"), _hi=F.max("value"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(over(value - F.col("_lo"), width) - 1e-7)))).otherwise(1)
    counts = df.groupBy(*by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first(width).alias("_w"))
    return counts.select(*by, "bin", "n", (F.col("_lo") + (F.col("bin") - 0.5) * F.col("_w")).alias("mid"), "_lo", "_w")


def otsu(df: DataFrame) -> DataFrame:
    """``threshold`` of every channel: the middle of the first bin of greatest variance between classes.

    Empty bins repeat the variance of the bin before and so are never first."""
    h = histogram(df)
    by = keys(h)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    h = h.withColumns({"_wb": F.sum("n").over(up), "_sb": F.sum(F.col("n") * F.col("mid")).over(up), "_t": F.sum("n").over(all_), "_s": F.sum(F.col("n") * F.col("mid")).over(all_)})
    wf = F.col("_t") - F.col("_wb")
    between = F.when(wf > 0, F.col("_wb") * wf * F.pow(F.col("_sb") / F.col("_wb") - over(F.col("_s") - F.col("_sb"), wf.cast("double")), 2))
    # ties of the variance are equal up to rounding
    best = F.struct(F.round(between, 9).alias("v"), (-F.col("bin")).alias("b"), F.col("mid"))
    return h.groupBy(*by).agg(F.max(F.when(between.isNotNull(), best)).alias("best"), F.min("mid").alias("first")).select(*by, F.coalesce("best.mid", "first").alias("threshold"))


def triangle(df: DataFrame) -> DataFrame:
    """``threshold`` of every channel: the bin farthest from the line of the peak to the far end."""
    h = histogram(df)
    by = keys(h)
    peak = h.groupBy(*by).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("p"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    full = peak.select(*by, "_lo", "_w", (-F.col("p.b")).alias("peak"), F.col("p.n").alias("y1"), F.explode(F.sequence(F.lit(1), F.lit(BINS))).alias("bin"))
    full = full.join(h.select(*by, "bin", "n"), [*by, "bin"], "left").fillna(0, ["n"])
    mid = lambda b: F.col("_lo") + (b - 0.5) * F.col("_w")
    end = F.when(F.col("peak") <= BINS // 2, BINS).otherwise(1)
    ends = h.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("bin").alias("_b"), F.col("n").alias("y2"))
    full = full.withColumn("end", end).join(ends, [F.col(k) == F.col(f"_{k}") for k in by] + [F.col("end") == F.col("_b")], "left").fillna(0, ["y2"])
    x1, x2, y1, y2 = mid(F.col("peak")), mid(F.col("end")), F.col("y1"), F.col("y2")
    distance = over(F.abs((y2 - y1) * mid(F.col("bin")) - (x2 - x1) * F.col("n") + x2 * y1 - y2 * x1), F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)))
    between = F.col("bin").between(F.least("peak", "end"), F.greatest("peak", "end"))
    best = F.struct(F.round(distance, 9).alias("d"), (-F.col("bin")).alias("b"), mid(F.col("bin")).alias("mid"))
    return full.where(between).groupBy(*by).agg(F.max(best).alias("best"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w")).select(*by, F.when(F.col("_w") > 0, F.col("best.mid")).otherwise(F.col("_lo")).alias("threshold"))


def wide(df: DataFrame, channels: int = 3) -> DataFrame:
    """One row per pixel with columns ``c1 .. cn``."""
    rest = [c for c in ("image_id", "n_rows", "n_cols", "row", "col")]
    return df.where(F.col("channel") <= channels).groupBy(*rest).agg(*[F.max(F.when(F.col("channel") == k, F.col("value"))).alias(f"c{k}") for k in range(1, channels + 1)])


STAINS = ("hematoxylin", "eosin", "residual")


def deconvolve(df: DataFrame, method: str = "macenko", stains=None) -> DataFrame:
    """``stain, value``: concentrations of hematoxylin, eosin and the residual, not below 0.

    The stain vectors are those given (an invertible 3×3 matrix), the fixed ones (``ruifrok``), or
    each image's own (``macenko``); an image whose own can't be inverted has NULLs. Images of
    fewer than three channels have no rows. ``df`` are pixels or rasters. An image of one tile is
    worked on at once; of larger ones the stains come from ``macenko_stains``' aggregations."""
    if method not in ("macenko", "ruifrok"):
        raise ValueError(f"unknown method {method}")
    fixed = None
    if stains is not None or method == "ruifrok":
        matrix = np.asarray(RUIFROK if stains is None else stains, float)
        if matrix.shape != (3, 3) or abs(np.linalg.det(matrix)) < 1e-12:
            raise ValueError("stains must be an invertible 3×3 matrix")
        fixed = np.linalg.inv(matrix)

    def of(x: dict) -> Iterator[list]:
        r0, r1, c0, c1 = rasters.extent(x)
        if not {1, 2, 3} <= set(x["channels"]):
            return
        a, state = rasters.arrays(x, r1 - r0, c1 - c0)
        at = [x["channels"].index(k) for k in (1, 2, 3)]
        od = -np.log(np.fmin(np.maximum(a[at], 1e-6), 1.0))
        known = None if state is None else (state[at] == 2).all(axis=0)
        if fixed is not None:
            m = fixed
        else:
            own = x["stains"]
            if own is None:
                # a NULL counts as the least value, as in macenko_stains
                there = od.reshape(3, -1) if state is None else np.where(state[at] == 2, od, -np.log(1e-6))[:, (state > 0).any(axis=0)]
                own = own_stains(there)
            m = np.array([list(r) for r in own], float)
            m = np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-12 else None
        step = max(1, rasters.ROWS // (c1 - c0))
        for j in range(3):
            v = np.zeros(od.shape[1:]) if m is None else np.maximum(od[0] * m[0, j] + od[1] * m[1, j] + od[2] * m[2, j], 0.0)
            for i in range(0, r1 - r0, step):
                part = slice(i, i + step)
                lost = None if m is not None and known is None else np.where(True if known is None else known[part], 1 if m is None else 2, 0) * np.ones((len(v[part]), 1), int)
                yield from rasters.rows(x["image_id"], x["n_rows"], x["n_cols"], np.arange(r0, r1)[part] + 1, np.arange(c0, c1) + 1, j + 1, v[part], lost, False)

    small, large = rasters.parted(df)
    none = F.lit(None).cast(_MATRIX)
    out = rasters.mapped(small.withColumn("stains", none), of, rasters.PIXELS)
    if large is not None:
        own = large.withColumn("stains", none)
        if fixed is None:
            found = sized(_stains(wide(rasters.pixels(large)))).withColumnRenamed("image_id", "_i")
            own = large.join(found, F.col("image_id") == F.col("_i")).drop("_i")
        out = out.unionByName(rasters.mapped(own, of, rasters.PIXELS))
    name = F.element_at(F.array(*[F.lit(x) for x in STAINS]), F.col("channel"))
    return out.select("image_id", "n_rows", "n_cols", "row", "col", name.alias("stain"), "value")


_MATRIX = "array<array<double>>"


def macenko_stains(df: DataFrame) -> DataFrame:
    """``image_id, stains``: the stain matrix of every image from its stained pixels, stains as columns.

    Stained are pixels of an optical density above 0.15. Two aggregations give each image's
    covariances and the 1st and 99th percentile of the angle in the plane of its two main axes;
    only these few numbers of an image go to Python. Axes point to positive sums. Images of
    fewer than ten stained pixels have the fixed vectors."""
    return _stains(wide(df))


def _plane(cov: np.ndarray) -> np.ndarray:
    """The two main axes of covariances, as columns."""
    e = np.linalg.eigh(cov)[1][:, [2, 1]]
    return e * np.where(e.sum(axis=0) < 0, -1, 1)


def _vectors(e: np.ndarray, low: float, high: float) -> np.ndarray:
    """Stains as columns: those at two angles of the plane, and what is across to both."""
    v1, v2 = (e @ np.array([np.cos(q), np.sin(q)]) for q in (low, high))
    v1, v2 = v1 / np.linalg.norm(v1), v2 / np.linalg.norm(v2)
    v3 = np.cross(v1, v2)
    length = np.linalg.norm(v3)
    return np.column_stack([v1, v2, v3 / length if length else v3])


def own_stains(od: np.ndarray) -> np.ndarray | tuple:
    """The stain matrix of an image whose optical densities (3 by pixels) are held at once, as by ``macenko_stains``."""
    od = od[:, np.sqrt(np.square(od).sum(axis=0)) > 0.15]
    n = od.shape[1]
    if n < 10:
        return RUIFROK
    e = _plane(np.cov(od))
    angle = np.arctan2(*(e.T @ od)[::-1])
    ranks = [(n - 1) * s for s in (0.01, 0.99)]
    held = np.partition(angle, sorted({min(int(q) + k, n - 1) for q in ranks for k in (0, 1)}))
    low, high = (held[int(q)] + (q - int(q)) * (held[min(int(q) + 1, n - 1)] - held[int(q)]) for q in ranks)
    return _vectors(e, low, high)


def _stains(flat: DataFrame) -> DataFrame:
    od = [optical_density(F.col(f"c{k}")).alias(f"o{k}") for k in (1, 2, 3)]
    stained = flat.select("image_id", "row", "col", *od).where("sqrt(o1*o1 + o2*o2 + o3*o3) > 0.15")
    pairs = [(i, j) for i in range(1, 4) for j in range(i, 4)]
    sums = stained.groupBy("image_id").agg(F.count("*").alias("n"), *[F.covar_samp(f"o{i}", f"o{j}").alias(f"v{i}{j}") for i, j in pairs]).where("n >= 10")

    @F.pandas_udf("array<double>")
    def axes(*v: pd.Series) -> pd.Series:
        out = []
        for row in np.column_stack(v):
            cov = np.zeros((3, 3))
            for (i, j), x in zip(pairs, row):
                cov[i - 1, j - 1] = cov[j - 1, i - 1] = x
            out.append(_plane(cov).T.ravel())
        return pd.Series(out)

    @F.pandas_udf(_MATRIX)
    def matrix(plane: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for p, a, b in zip(plane, low, high):
            out.append(_vectors(np.asarray(p).reshape(2, 3).T, a, b).tolist())
        return pd.Series(out)

    planes = sums.select(F.col("image_id").alias("_i"), axes(*[f"v{i}{j}" for i, j in pairs]).alias("p"))
    on = lambda k: sum((F.col(f"o{i + 1}") * F.col("p")[3 * k + i] for i in (1, 2)), F.col("o1") * F.col("p")[3 * k])
    planes = sized(planes)
    turned = stained.join(planes, F.col("image_id") == F.col("_i"))
    angles = quantiles(turned, "image_id", F.atan2(on(1), on(0)), ["row", "col"], [0.01, 0.99]).join(planes, F.col("image_id") == F.col("_i"))
    found = angles.select("_i", matrix("p", F.col("q")[0], F.col("q")[1]).alias("m"))
    fixed = F.array(*[F.array(*[F.lit(x) for x in row]) for row in RUIFROK])
    return flat.select("image_id").distinct().join(found, F.col("image_id") == F.col("_i"), "left").select("image_id", F.coalesce("m", fixed).alias("stains"))


CONTRASTS = (None, "stretch", "clahe", "equalize")


def scales(images: DataFrame, target_resolution: float) -> DataFrame:
    """``image_id, scale`` that bring images to a pixel size (µm); those of unknown size stay as they are."""
    if target_resolution <= 0:
        raise ValueError("the target resolution must be positive")
    now = F.col("resolution.x_um")
    return images.select("image_id", F.when(now > 0, now / float(target_resolution)).otherwise(1.0).alias("scale"))


def preprocess(df: DataFrame, stain: str | None = None, denoise: bool = False, contrast: str | None = None, scale: float | None = None, target_resolution: float | None = None, images: DataFrame | None = None) -> DataFrame:
    """Stain normalization, 3×3 mean, contrast (``stretch``, or ``clahe``, which is ``equalize``) and resampling, in this order.

    Resampling is by ``scale``, or to ``target_resolution`` from the pixel widths of ``images``
    (``image_id, resolution``); an image of unknown size isn't resampled. ``preprocessed`` gives
    what ``images`` says afterwards. ``df`` are pixels or rasters; columns other than those of
    pixels are dropped. An image of one tile goes through all steps in one task; of larger ones tiles with
    a margin of two pixels are exchanged once, and statistics of images come from those of tiles."""
    if scale is not None and scale <= 0:
        raise ValueError("the scale must be positive")
    if contrast not in CONTRASTS:
        raise ValueError(f"unknown contrast {contrast}")
    if stain not in (None, "", *STAIN_METHODS):
        raise ValueError(f"unknown stain normalization {stain}")
    if target_resolution is not None:
        if images is None:
            raise ValueError("a target resolution needs the resolutions of the images")
        to = scales(images, target_resolution)
    channels = rasters.is_rasters(df) or "channel" in df.columns
    if contrast in ("clahe", "equalize"):
        # its counts of bins are of whole images, between the steps that work on tiles
        df = equalize(preprocess(df, stain, denoise) if stain or denoise else rasters.pixels(df) if rasters.is_rasters(df) else df)
        stain, denoise, contrast = None, False, None
        if scale is None and target_resolution is None:
            return df
    small, large = rasters.parted(df)
    if target_resolution is not None:
        small, large = (t if t is None else t.join(to, "image_id") for t in (small, large))
    else:
        small, large = (t if t is None else t.withColumn("scale", F.lit(scale).cast("double")) for t in (small, large))
    out = prepare.small(small, bool(stain), denoise, bool(contrast))
    if large is not None:
        out = out.unionByName(prepare.large(large, bool(stain), denoise, bool(contrast)))
    return out if channels else out.drop("channel")


def preprocessed(images: DataFrame, stain: str | None = None, denoise: bool = False, contrast: str | None = None, target_resolution: float | None = None) -> DataFrame:
    """``images`` (with ``n_rows, n_cols, resolution, history``) as they are after ``preprocess``."""
    steps = [*([f"stain_norm:{stain}"] if stain else []), *(["denoise:mean3x3"] if denoise else []), *([f"contrast:{contrast}"] if contrast else [])]
    out = images.withColumn("history", F.concat(F.coalesce("history", F.array().cast("array<string>")), F.array(*map(F.lit, steps)).cast("array<string>")))
    if target_resolution is None:
        return out
    out = out.join(scales(images, target_resolution).withColumnRenamed("image_id", "_i"), F.col("image_id") == F.col("_i")).drop("_i")
    known, to = F.col("resolution.x_um") > 0, float(target_resolution)
    changed = {
        "n_rows": F.when(known, scaled(F.col("n_rows"), F.col("scale"))).otherwise(F.col("n_rows")),
        "n_cols": F.when(known, scaled(F.col("n_cols"), F.col("scale"))).otherwise(F.col("n_cols")),
        "history": F.when(known, F.array_append("history", F.lit(f"resample:{target_resolution:g}um"))).otherwise(F.col("history")),
        "resolution": F.when(known, F.struct(F.lit(to).alias("x_um"), F.lit(to).alias("y_um"))).otherwise(F.col("resolution")),
    }
    return out.withColumns(changed).drop("scale")
