"""Measurements of cells: intensities, shape, texture, place, and convex hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.operators.stencil import border
from histospark.runtime import over, same_size, stage

GROUPS = ("intensity", "morphology", "texture", "location")
STATISTICS = ("mean", "sd", "median", "min", "max", "q25", "q75")
CELL = ["image_id", "label"]


def eccentricity() -> Column:
    """From exact integer moments (``n, sr, sc, srr, scc, src``): no noise for symmetric cells.

    NULL where a cell has no extent in some direction."""
    n, sr, sc, srr, scc, src = (F.col(c).cast("double") for c in ("n", "sr", "sc", "srr", "scc", "src"))
    scale = n * (n - 1)
    a, d, b = over(n * srr - sr * sr, scale), over(n * scc - sc * sc, scale), over(n * src - sr * sc, scale)
    m, q = (a + d) / 2, F.sqrt(F.pow((a - d) / 2, 2) + b * b)
    return F.when((n > 1) & (m - q > 1e-9), F.sqrt(1 - over(m - q, m + q)))


def moments(labels: DataFrame) -> DataFrame:
    """Per cell its area, centroid, bounding box, perimeter, circularity and eccentricity.

    The perimeter counts pixels on the image's edge or beside another label."""
    row, col = F.col("row").cast("bigint"), F.col("col").cast("bigint")
    sums = border(labels).groupBy(*CELL).agg(
        F.count("*").alias("n"),
        F.sum(row).alias("sr"),
        F.sum(col).alias("sc"),
        F.sum(row * row).alias("srr"),
        F.sum(col * col).alias("scc"),
        F.sum(row * col).alias("src"),
        F.sum(F.col("is_border").cast("int")).alias("perimeter"),
        *[f(c).alias(f"bbox_{c}_{k}") for c in ("row", "col") for k, f in (("min", F.min), ("max", F.max))],
    )
    circularity = over(4 * math.pi * F.col("n"), (F.col("perimeter") * F.col("perimeter")).cast("double"))
    return sums.select(
        *CELL, F.col("n").alias("area"), F.col("perimeter").cast("double").alias("perimeter"), circularity.alias("circularity"), eccentricity().alias("eccentricity"), (F.col("sr") / F.col("n")).alias("centroid_row"), (F.col("sc") / F.col("n")).alias("centroid_col"), *[f"bbox_{c}_{k}" for c in ("row", "col") for k in ("min", "max")]
    )


def _convex(cell: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which points of chains (sorted by cell and row) are corners of the hull on the side of large ``c``.

    Points that don't lie beyond the line of their neighbours are no corners; they are taken away
    from all chains at once until none is left."""
    left = np.arange(len(cell))
    while len(left) > 2:
        k, y, x = cell[left], r[left], c[left]
        inner = (k[1:-1] == k[:-2]) & (k[1:-1] == k[2:])
        over = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (x[2:] - x[:-2]) * (y[1:-1] - y[:-2])
        drop = inner & (over <= 0)
        if not drop.any():
            break
        left = left[np.concatenate([[True], ~drop, [True]])]
    return left


def rings(cell: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Corners of the convex hulls of cells, given each row's ends: cell, x, y in the order of the ring, and twice the area of each cell.

    Cells are numbered 0.. and rows sorted by cell and row. A ring starts at its least x, of several the
    least y, and goes on along the least y."""
    r, c0, c1 = (v.astype(np.int64) for v in (r, c0, c1))
    right, left = _convex(cell, r, c1), _convex(cell, r, -c0)[::-1]
    single = c0[left] == c1[left]
    # a first or last row of one pixel is the same corner on both sides
    edge = np.concatenate([[True], cell[1:] != cell[:-1]]) | np.concatenate([cell[1:] != cell[:-1], [True]]) if len(cell) else np.zeros(0, bool)
    left = left[~(single & edge[left])]
    who, x, y = np.concatenate([cell[right], cell[left]]), np.concatenate([c1[right], c0[left]]), np.concatenate([r[right], r[left]])
    order = np.argsort(who, kind="stable")
    who, x, y = who[order], x[order], y[order]
    n = int(cell[-1]) + 1 if len(cell) else 0
    size = np.bincount(who, minlength=n)
    start = np.cumsum(size) - size
    place = np.arange(len(who)) - start[who]
    first = np.lexsort((y, x, who))[start[size > 0]] if len(who) else np.empty(0, int)
    turn = np.zeros(n, np.int64)
    turn[who[first]] = place[first]
    order = np.argsort(start[who] + (place - turn[who]) % size[who], kind="stable")
    who, x, y = who[order], x[order], y[order]
    after = np.where(np.arange(len(who)) + 1 < start[who] + size[who], np.arange(len(who)) + 1, start[who])
    twice = np.bincount(who, (x * y[after] - y * x[after]).astype(float), n)
    return who, x, y, np.abs(twice)


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's choice of the vertices of a closed ring, which starts and ends at one."""
    if tolerance <= 0 or len(points) < 4:
        return points
    closed = np.vstack([points, points[:1]])
    keep, todo = {0, len(closed) - 1}, [(0, len(closed) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = closed[a], closed[b], closed[a + 1 : b]
        length = np.hypot(*(q - p))
        d = np.hypot(*(mid - p).T) if length == 0 else np.abs((q[0] - p[0]) * (mid[:, 1] - p[1]) - (q[1] - p[1]) * (mid[:, 0] - p[0])) / length
        k = int(d.argmax())
        if d[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    out = closed[sorted(keep)][:-1]
    return out if len(out) > 2 else points


_HULLS = "image_id bigint, label int, n bigint, hull_area double, ring array<struct<x: double, y: double>>"


def hulls(labels: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per cell ``n, hull_area`` and ``ring`` (x the column, y the row), of pixel centres.

    Only the ends of each row of a cell go to Python, where all cells of a batch are worked on at
    once. Cells of fewer than three pixels have their number of pixels for an area; cells on a
    line 0."""
    rows = labels.groupBy(*CELL, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("m"))
    ends = F.sort_array(F.collect_list(F.struct("row", "c0", "c1")))
    cells = rows.groupBy(*CELL).agg(F.sum("m").alias("n"), ends.alias("e")).select(F.col("image_id").cast("bigint"), F.col("label").cast("int"), "n", *[F.col(f"e.{k}").alias(k) for k in ("row", "c0", "c1")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(3).offsets))
            cell = np.repeat(np.arange(batch.num_rows), sizes)
            who, x, y, twice = rings(cell, *(np.asarray(batch.column(k).flatten()) for k in (3, 4, 5)))
            n = np.asarray(batch.column(2))
            size = np.bincount(who, minlength=batch.num_rows)
            if tolerance > 0:
                parts = [simplified(p, tolerance) for p in np.split(np.column_stack([x, y]).astype(float), np.cumsum(size)[:-1])]
                size, (x, y) = np.array([len(p) for p in parts]), np.concatenate(parts).T
            points = pa.StructArray.from_arrays([pa.array(x.astype(float)), pa.array(y.astype(float))], ["x", "y"])
            ring = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), points)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.where(n < 3, n, twice / 2).astype(float)), ring], ["image_id", "label", "n", "hull_area", "ring"])

    return cells.mapInArrow(of, _HULLS)


def morphology(labels: DataFrame) -> DataFrame:
    """``moments`` with ``solidity``: area by area of the hull of pixel centres, which may exceed 1."""
    h = hulls(labels).select(F.col("image_id").alias("_i"), F.col("label").alias("_l"), "hull_area")
    df = moments(labels).join(h, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_l")))
    return df.withColumn("solidity", over(F.col("area"), F.col("hull_area"))).drop("_i", "_l", "hull_area")


def polygons(labels: DataFrame, simplify: bool = False, tolerance: float = 1.0) -> DataFrame:
    """``image_id, label, ring`` of cells of three pixels or more that aren't on a line; rings are closed."""
    h = hulls(labels, tolerance if simplify else 0.0).where("n >= 3 and size(ring) >= 3")
    return h.select(*CELL, F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))


def outline_points(polys: DataFrame) -> DataFrame:
    """Rings as rows ``image_id, label, seq, row, col``."""
    return polys.select(*CELL, F.posexplode("ring").alias("seq", "p")).select(*CELL, "seq", F.col("p.y").alias("row"), F.col("p.x").alias("col"))


def intensity(joined: DataFrame, channels: dict[int, str]) -> DataFrame:
    """Mean, deviation, median, extremes and quartiles per cell and channel, in one aggregation."""
    out = []
    for k, name in channels.items():
        v = F.when(F.col("channel") == k, F.col("value"))
        q = F.percentile(v, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
        out += [F.avg(v).alias(f"{name}_mean"), F.stddev_samp(v).alias(f"{name}_sd"), q[1].alias(f"{name}_median"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), q[0].alias(f"{name}_q25"), q[2].alias(f"{name}_q75")]
    return joined.groupBy(*CELL).agg(*out)


def entropy(joined: DataFrame, channels: dict[int, str]) -> DataFrame:
    """Entropy (bits) of the values at two decimals per cell and channel."""
    counts = joined.where("value is not null").groupBy(*CELL, "channel", F.bround("value", 2).alias("_bin")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*CELL, "channel").agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"))
    # -sum p log2 p = log2 t - sum n log2 n / t
    bits = F.greatest(F.log2("_t") - F.col("_s") / F.col("_t"), F.lit(0.0))
    return total.groupBy(*CELL).agg(*[F.max(F.when(F.col("channel") == k, bits)).alias(f"{name}_entropy") for k, name in channels.items()])


def channel_numbers(names: list[str], wanted: list[str | int] | None = None) -> dict[int, str]:
    """Numbers and names of the wanted channels, by name or number, in the order asked for."""
    if wanted is None:
        return {i + 1: n for i, n in enumerate(names)}
    out = {}
    for w in wanted:
        k = names.index(w) + 1 if isinstance(w, str) and w in names else w
        if not isinstance(k, int) or not 1 <= k <= len(names):
            raise ValueError(f"unknown channel {w}")
        out[k] = names[k - 1]
    return out


def extract_features(pixels: DataFrame, labels: DataFrame, names: list[str], features: tuple[str, ...] = GROUPS, channels: list[str | int] | None = None) -> DataFrame:
    """One row per cell 1..n of each image, n being its greatest label; absent labels have NULLs.

    Pixels are filtered to the wanted channels before they are joined with the labels. Images and
    masks of different sizes are an error."""
    if unknown := set(features) - set(GROUPS):
        raise ValueError(f"unknown features {sorted(unknown)}")
    picked = channel_numbers(names, channels)
    ids = labels.groupBy("image_id").agg(F.max("label").alias("_n")).select("image_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("label"))
    sized = lambda df, name: df.withColumnsRenamed({"n_rows": f"{name}_rows", "n_cols": f"{name}_cols"}).select("image_id", "row", "col", f"{name}_rows", f"{name}_cols", *(["channel", "value"] if name == "p" else ["label"]))
    # labels are the smaller side, and their pixels hash evenly, so they needn't be sorted
    joined = sized(pixels.where(F.col("channel").isin(list(picked))), "p").join(sized(labels, "l").hint("shuffle_hash"), ["image_id", "row", "col"])
    joined = joined.select(*CELL, "channel", same_size("p", "l", F.col("value")).alias("value"))
    shape = ["area", "perimeter", "circularity", "eccentricity", "solidity"]
    of_group = {"intensity": [f"{n}_{k}" for n in picked.values() for k in STATISTICS], "morphology": shape, "texture": [f"{n}_{k}" for n in picked.values() for k in ("entropy", "iqr")], "location": ["centroid_row", "centroid_col"]}
    if {"intensity", "texture"} <= set(features):
        joined = stage(joined)  # labelled pixels only, read for the statistics and for the entropy
    parts = []
    if {"intensity", "texture"} & set(features):
        # one aggregation for both groups, and its quartiles once
        parts.append(intensity(joined, picked).withColumns({f"{n}_iqr": F.col(f"{n}_q75") - F.col(f"{n}_q25") for n in picked.values()}))
    if "texture" in features:
        parts.append(entropy(joined, picked))
    if "morphology" in features:
        parts.append(morphology(labels).select(*CELL, *shape))
    if "location" in features:
        parts.append(labels.groupBy(*CELL).agg(F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col")))
    for p in parts:
        ids = ids.join(p, CELL, "left")
    return ids.select("image_id", F.col("label").alias("cell_id"), *[c for g in GROUPS if g in features for c in of_group[g]])


def area_summary(labels: DataFrame) -> DataFrame:
    """Per image the cells present and the least, median and greatest area."""
    areas = labels.groupBy(*CELL).agg(F.count("*").alias("area"))
    return areas.groupBy("image_id").agg(F.count("*").alias("n"), F.min("area").alias("min_area"), F.percentile("area", 0.5).alias("median_area"), F.max("area").alias("max_area"))
