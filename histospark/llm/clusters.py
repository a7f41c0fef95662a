"""Groups of cells of alike shape, by bisecting k-means and the gaps between its leaves.

Leaves are reported with their sizes and the cells nearest to their centres (``assign_leaves``,
``describe``); groups are made of leaves.

Cells are points of log10 area (in pixels), circularity, eccentricity and solidity, each
divided by its standard deviation over all cells. Points are first summed in the cells of
a fine grid: counts, sums and products, from which any node's moments follow exactly.
Grid cells that hold less than a fixed share of all points are set aside as background;
so at most ``1 / DENSE_SHARE`` remain, whatever the number of points. Over these, across
the cluster, each node whose dispersion exceeds the limit is split in two by k-means, the
largest dispersions and all others above the limit in the same round, until every leaf is
compact; what a gap sets apart within a leaf becomes a leaf too. Leaves that no gap separates, i.e. that meet in grid cells nearly as full as
theirs, make a group.
Every cell then belongs to the group nearest by its covariance, or to none if it lies far
from all.

Defined results: several rows of a cell count once, by the mean of their values; NULL, NaN
and infinite values are left out of the distance, and a cell with fewer than two values or
of area 0 has no group; with fewer than ``MIN_POINTS`` points there are no groups; further
columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.runtime import finite, stage

SHAPE = ["log_area", "circularity", "eccentricity", "solidity"]
D = len(SHAPE)
#: Grid cells with a smaller share of all points are background.
DENSE_SHARE = 2e-5
#: Largest standard deviation along any direction of a compact leaf, in units of the columns'.
COMPACT = 0.3
MAX_LEAVES = 1024
#: Side of a grid cell, in units of the columns' standard deviations.
GRID = 0.35
#: Share of all points below which a leaf joins no two others: it goes to the neighbour it borders on most.
SMALL_LEAF = 0.002
#: Points of the fullest grid cell, as a multiple of the background's bound, below which joined leaves that are
#: a small share of all points are scattered artefacts and no group.
CROWDED = 2.0
#: Squared distance from a group's centre, in units of its covariance, beyond which a cell isn't of it.
FAR = 45.0
#: Two leaves adjoin where two neighbouring grid cells of theirs both hold this share of the lower of their peaks.
VALLEY = 0.2
MIN_POINTS = 20
#: Rounds of a node's k-means, which ends when its centres stay.
LLOYD_ROUNDS = 50
_PAIRS = list(itertools.combinations_with_replacement(range(D), 2))
_SUMS = [f"s{i}" for i in range(D)] + [f"q{i}{j}" for i, j in _PAIRS]


def shapes(features: DataFrame) -> DataFrame:
    """One row per cell: ``image_id, cell_id`` and SHAPE. ``features`` must have ``area_px``."""
    area = F.col("area_px")
    there = (area > 0) | area.isNull()
    rows = features.select("image_id", "cell_id", F.when(area > 0, F.log10(area)).alias("log_area"), *[F.when(there, finite(F.col(c).cast("double"))).alias(c) for c in SHAPE[1:]])
    return rows.where("image_id is not null and cell_id is not null").groupBy("image_id", "cell_id").agg(*[F.avg(c).alias(c) for c in SHAPE])


@dataclass
class Groups:
    """Centres and inverse covariances in scaled coordinates, largest group first; the leaves, and of each its group or 0."""

    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    inverses: np.ndarray
    leaves: np.ndarray
    group_of_leaf: np.ndarray
    rounds: int


def _moments(row) -> tuple[float, np.ndarray, np.ndarray]:
    n = float(row["n"])
    m = np.array([row[f"s{i}"] for i in range(D)]) / n
    c = np.zeros((D, D))
    for i, j in _PAIRS:
        c[i, j] = c[j, i] = row[f"q{i}{j}"] / n - m[i] * m[j]
    return n, m, c


def _nearer(centres: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame | Column:
    """0 or 1: the nearer of its node's two centres, for the mean of a grid cell."""
    table = F.create_map(*[x for k, (a, b) in centres.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in (*(2 * (b - a)), *(a @ a - b @ b,))]))])
    w = F.element_at(table, F.col("node"))
    # 2 (b - a) x + |a|^2 - |b|^2 > 0 where b is nearer
    side = sum((w[i] * F.col(f"s{i}") / F.col("n") for i in range(D)), w[D])
    return F.when(side > 0, 1).otherwise(0)


def _apart(grid: pa.Table, least: float) -> np.ndarray:
    """The leaf of each grid cell, where a part that a gap sets apart within its leaf and that holds a group has its own.

    A part of few of all points hardly widens a leaf that holds others too, so dispersion can't find it."""
    at = {c: i for i, c in enumerate(zip(*(grid[f"g{i}"].to_pylist() for i in range(D))))}
    offsets = list(itertools.product((-1, 0, 1), repeat=D))
    part = np.full(len(at), -1)
    for cell, i in at.items():
        if part[i] >= 0:
            continue
        part[i], todo = i, [cell]
        while todo:
            c = todo.pop()
            for o in offsets:
                near = (c[0] + o[0], c[1] + o[1], c[2] + o[2], c[3] + o[3])
                k = at.get(near)
                if k is not None and part[k] < 0:
                    part[k] = i
                    todo.append(near)
    n, node = grid["n"].to_numpy(), grid["node"].to_numpy().copy()
    holds = [i for i in np.unique(part) if n[part == i].sum() >= MIN_POINTS and n[part == i].max() >= CROWDED * least]
    new = 1 << 40
    for k in np.unique(node):
        own = [(n[there].sum(), there) for i in holds for there in [(part == i) & (node == k)] if there.any()]
        for _, there in sorted(own, key=lambda x: -x[0])[1:]:
            node[there] = new
            new += 1
    return node


def find_groups(cells: DataFrame) -> Groups | None:
    """Groups of the points of ``cells`` (from ``shapes``, written before)."""
    whole = cells.dropna(subset=SHAPE)
    stats = whole.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(SHAPE)], *[F.stddev_samp(c).alias(f"d{i}") for i, c in enumerate(SHAPE)]).first()
    if stats.n < MIN_POINTS:
        return None
    mean = np.array([stats[f"m{i}"] for i in range(D)])
    scale = np.array([stats[f"d{i}"] or 1.0 for i in range(D)])
    width = GRID
    z = [(F.col(c) - float(mean[i])) / float(scale[i]) for i, c in enumerate(SHAPE)]
    points = whole.select(*[F.floor(v / width).cast("int").alias(f"g{i}") for i, v in enumerate(z)], *[v.alias(f"z{i}") for i, v in enumerate(z)])
    grid = points.groupBy(*[f"g{i}" for i in range(D)]).agg(F.count("*").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(D)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])
    least = max(2.0, DENSE_SHARE * stats.n)
    dense = stage(grid.where(F.col("n") >= least).withColumn("node", F.lit(1).cast("bigint")).coalesce(8))

    rounds = 0
    single: set[int] = set()
    while True:
        nodes = {r.node: _moments(r) for r in dense.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS]).collect()}
        spread = {k: np.linalg.eigh(c) for k, (_, _, c) in nodes.items()}
        split = sorted((k for k, (v, _) in spread.items() if v[-1] > COMPACT**2 and k not in single), key=lambda k: -spread[k][0][-1])
        if not split:
            break
        if len(nodes) + len(split) > MAX_LEAVES:
            raise ValueError(f"more than {MAX_LEAVES} leaves: the dispersion limit leaves too many parts")
        rounds += 1
        centres = {k: (nodes[k][1] - np.sqrt(v[-1]) * 0.8 * e[:, -1], nodes[k][1] + np.sqrt(v[-1]) * 0.8 * e[:, -1]) for k in split for v, e in [spread[k]]}
        for _ in range(LLOYD_ROUNDS):
            sides = dense.where(F.col("node").isin(split)).groupBy("node", _nearer(centres).alias("side")).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(D)]).collect()
            new = {k: list(v) for k, v in centres.items()}
            for r in sides:
                new[r.node][r.side] = np.array([r[f"s{i}"] for i in range(D)]) / r.n
            moved = max(np.abs(new[k][s] - centres[k][s]).max() for k in split for s in (0, 1))
            centres = {k: tuple(v) for k, v in new.items()}
            if moved < 0.002:
                break
        halves = {(r.node, r.side) for r in sides}
        for k in split:
            if not {(k, 0), (k, 1)} <= halves:
                single.add(k)  # a single grid cell can't be split
        divide = [k for k in split if k not in single]
        if divide:
            dense = stage(dense.withColumn("node", F.when(F.col("node").isin(divide), F.col("node") * 2 + _nearer({k: centres[k] for k in divide})).otherwise(F.col("node"))))

    held = dense.toArrow()  # at most 1 / DENSE_SHARE rows
    node = _apart(held, least)
    if (node != held["node"].to_numpy()).any():
        dense = stage(cells.sparkSession.createDataFrame(held.drop_columns("node").append_column("node", pa.array(node))))
        nodes = {r.node: _moments(r) for r in dense.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS]).collect()}

    offsets = [o for o in itertools.product((-1, 0, 1), repeat=D) if o > (0,) * D]
    near = dense.select("node", "n", F.explode(F.array(*[F.struct(*[(F.col(f"g{i}") + o[i]).alias(f"h{i}") for i in range(D)]) for o in offsets])).alias("h")).select("node", "n", "h.*")
    there = dense.select(F.col("node").alias("other"), F.col("n").alias("m"), *[F.col(f"g{i}").alias(f"h{i}") for i in range(D)])
    # at most MAX_LEAVES squared
    links = near.join(there, [f"h{i}" for i in range(D)]).where("node <> other").groupBy("node", "other").agg(F.max(F.least("n", "m")).alias("border")).collect()
    peak = {r.node: r.peak for r in dense.groupBy("node").agg(F.max("n").alias("peak")).collect()}
    group = {k: k for k in nodes}

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    def join(k: int, m: int) -> None:
        a, b = root(k), root(m)
        group[max(a, b)] = min(a, b)

    large = {k for k, v in nodes.items() if v[0] >= SMALL_LEAF * stats.n}
    meet = [r for r in links if r.border >= VALLEY * min(peak[r.node], peak[r.other])]
    for r in meet:
        if {r.node, r.other} <= large:
            join(r.node, r.other)
    # a small leaf lies at a group's edge or between two, so it takes one way up only
    for k in sorted(nodes.keys() - large):
        up = [(r.border, peak[m], m) for r in meet if k in (r.node, r.other) for m in [r.other if r.node == k else r.node] if m in large or (peak[m], m) > (peak[k], k)]
        if up:
            join(k, max(up)[2])
    merged: dict[int, list[tuple[float, np.ndarray, np.ndarray]]] = {}
    for k, v in nodes.items():
        merged.setdefault(root(k), []).append(v)
    found = []
    for name, parts in merged.items():
        n = sum(p[0] for p in parts)
        m = sum(p[0] * p[1] for p in parts) / n
        c = sum(p[0] * (p[2] + np.outer(p[1] - m, p[1] - m)) for p in parts) / n
        full = max(peak[k] for k in nodes if root(k) == name)
        if n >= MIN_POINTS and (n >= SMALL_LEAF * stats.n or full >= CROWDED * least):
            # the least variance is that of a grid cell, so that a thin group isn't a point
            found.append((n, m, np.linalg.inv(c + np.eye(D) * width**2 / 48), name))
    found.sort(key=lambda x: -x[0])
    number = {x[3]: i + 1 for i, x in enumerate(found)}
    leaves = sorted(nodes, key=lambda k: (-nodes[k][0], k))
    return Groups(mean, scale, np.array([x[1] for x in found]).reshape(-1, D), np.array([x[2] for x in found]).reshape(-1, D, D), np.array([nodes[k][1] for k in leaves]).reshape(-1, D), np.array([number.get(root(k), 0) for k in leaves]), rounds)


def nearest(z: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Group (from 1, 0 for none) and squared distance of each row; NaN columns are left out."""
    best, at = np.full(len(z), np.inf), np.zeros(len(z), np.int32)
    there = ~np.isnan(z)
    for pattern in np.unique(there, axis=0):
        use = np.flatnonzero(pattern)
        if len(use) < 2:
            continue
        rows = np.flatnonzero((there == pattern).all(axis=1))
        for k, (centre, inverse) in enumerate(zip(groups.centres, groups.inverses)):
            part = inverse if len(use) == D else np.linalg.inv(np.linalg.inv(inverse)[np.ix_(use, use)])
            x = z[np.ix_(rows, use)] - centre[use]
            d = np.einsum("ij,jk,ik->i", x, part, x)
            better = (d < best[rows]) & (d <= FAR)
            best[rows[better]], at[rows[better]] = d[better], k + 1
    return at, best


def assign(cells: DataFrame, groups: Groups | None) -> DataFrame:
    """``cells`` with ``group_id`` (NULL for none) and ``distance`` to the group's centre."""
    if groups is None or not len(groups.centres):
        return cells.withColumns({"group_id": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})

    @F.pandas_udf("group_id int, distance double")
    def of(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        z = (np.column_stack([a, b, c, d]).astype(float) - groups.mean) / groups.scale
        at, d2 = nearest(z, groups)
        return pd.DataFrame({"group_id": pd.arrays.IntegerArray(at, at == 0), "distance": np.where(at > 0, np.sqrt(d2), np.nan)})

    return cells.withColumn("_g", of(*SHAPE)).select(*cells.columns, "_g.group_id", "_g.distance")


def assign_leaves(cells: DataFrame, groups: Groups | None) -> DataFrame:
    """Cells of which all of SHAPE is known, with ``leaf_id``, the leaf of the nearest centre, its ``distance``, and ``group_id``, the leaf's group."""
    whole = cells.dropna(subset=SHAPE)
    if groups is None:
        return whole.limit(0).withColumns({"leaf_id": F.lit(None).cast("int"), "distance": F.lit(None).cast("double"), "group_id": F.lit(None).cast("int")})

    @F.pandas_udf("leaf_id int, distance double")
    def of(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        z = (np.column_stack([a, b, c, d]).astype(float) - groups.mean) / groups.scale
        d2 = np.column_stack([((z - centre) ** 2).sum(axis=1) for centre in groups.leaves])
        at = d2.argmin(axis=1)
        return pd.DataFrame({"leaf_id": at.astype(np.int32) + 1, "distance": np.sqrt(d2[np.arange(len(z)), at])})

    rows = whole.withColumn("_l", of(*SHAPE)).select(*cells.columns, "_l.leaf_id", "_l.distance")
    return rows.withColumn("group_id", F.nullif(F.get(F.array(*[F.lit(int(g)) for g in groups.group_of_leaf]), F.col("leaf_id") - 1), F.lit(0)))


def same_group(pairs: DataFrame, cells: DataFrame, groups: Groups | None) -> DataFrame:
    """``pair_id`` of each pair whose cells are of the same group; only cells of pairs are assigned."""
    ends = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.col(f"image_id_{s}").alias("image_id"), F.col(f"cell_id_{s}").alias("cell_id")) for s in "ab"])).alias("c")).select("pair_id", "c.*")
    of = assign(cells.join(ends.select("image_id", "cell_id").distinct(), ["image_id", "cell_id"], "left_semi"), groups).where("group_id is not null").select("image_id", "cell_id", "group_id")
    ends = ends.join(of, ["image_id", "cell_id"])
    return ends.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("group_id").alias("lo"), F.max("group_id").alias("hi")).where("n >= 2 and lo = hi").select("pair_id")


def describe(assigned: DataFrame, by: str = "group_id", typical: int = 5) -> DataFrame:
    """Per group or leaf its size, mean shape, root mean square distance from the centre (``spread``) and, in rows of their own, its most typical cells.

    The rank filter is applied within each task before rows are exchanged."""
    also = ["group_id"] if by != "group_id" else []
    grouped = assigned.where(F.col(by).isNotNull())
    size = grouped.groupBy(by).agg(F.count("*").alias("n_cells"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("spread"), *[F.avg(c).alias(f"mean_{c}") for c in SHAPE])
    nearest_first = Window.partitionBy(by).orderBy("distance", "image_id", "cell_id")
    members = grouped.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= typical).select(by, *also, "rank", "image_id", "cell_id", "distance")
    return members.join(F.broadcast(size), by).select(by, *also, "n_cells", "spread", *[f"mean_{c}" for c in SHAPE], "rank", "image_id", "cell_id", "distance")  # at most MAX_LEAVES rows
