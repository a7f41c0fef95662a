"""Connected components, holes, distances, growth and relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators import tiles
from histospark.operators.forest import spanning_forest
from histospark.operators.order import ranked
from histospark.operators.stencil import along_col, along_row
from histospark.runtime import sized, stage, stage_observed

def _component_runs(on: DataFrame) -> DataFrame:
    """Runs within tiles, with ``first``, the least place in the scan of their component.

    Tiles are labelled on their own. Only runs that meet across the border of two tiles become
    edges, between the tiles' parts of components, and these are contracted."""
    right, below = (F.col("c1") % tiles.TILE == 0) & (F.col("c1") < F.col("n_cols")), (F.col("row") % tiles.TILE == 0) & (F.col("row") < F.col("n_rows"))
    r, seen = stage_observed(tiles.component_runs(on), cross=F.count_if(right | below))
    if not seen["cross"]:
        return r
    part = F.struct("image_id", "first")
    here = r.select("image_id", "row", "tc", "c0", "c1", part.alias("a"), right.alias("_right"), below.alias("_below"))
    there = r.select("image_id", "row", "tc", F.col("c0").alias("b0"), F.col("c1").alias("b1"), part.alias("b"))
    down = here.where("_below").withColumn("row", F.col("row") + 1).join(there, ["image_id", "row", "tc"]).where("b0 <= c1 and b1 >= c0")
    along = here.where("_right").withColumn("tc", F.col("tc") + 1).join(there, ["image_id", "row", "tc"]).where("b0 = c1 + 1")
    edges = down.select("a", "b").unionByName(along.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = spanning_forest(edges).roots
    least = roots.groupBy(F.col("root").alias("_root")).agg(F.min("node.first").alias("_least"))
    named = roots.join(least, F.col("root") == F.col("_root")).select(F.col("node.image_id").alias("_i"), F.col("node.first").alias("_f"), "_least")
    return r.join(named, (F.col("image_id") == F.col("_i")) & (F.col("first") == F.col("_f")), "left").withColumn("first", F.coalesce("_least", "first")).drop("_i", "_f", "_least")


def _pixels_of(r: DataFrame, *columns: str) -> DataFrame:
    return r.select("image_id", "n_rows", "n_cols", "row", F.explode(F.sequence("c0", "c1")).alias("col"), *columns)


def components(on: DataFrame) -> DataFrame:
    """Labels of the 4-connected components of the pixels of ``on`` (sparse).

    Labels count from 1 in the order in which a scan by rows meets the components."""
    r = _component_runs(on)
    ranks = sized(ranked(r.select("image_id", "first").distinct(), "image_id", "first", "label"))
    return _pixels_of(r.join(ranks, ["image_id", "first"]), "label")


def fill_holes(df: DataFrame) -> DataFrame:
    """Sparse pixels that are on, or off without a 4-connected way to the image's border; ``df`` is dense."""
    cut = ["image_id", "n_rows", "n_cols", "row", "col"]
    off = _component_runs(df.where("on = 0").select(*cut))
    outside = (F.col("row") == 1) | (F.col("row") == F.col("n_rows")) | (F.col("c0") == 1) | (F.col("c1") == F.col("n_cols"))
    holes = off.groupBy("image_id", "first").agg(F.max(outside).alias("outside")).where("not outside")
    filled = _pixels_of(off.join(holes, ["image_id", "first"], "left_semi"))
    return df.where("on = 1").select(*cut).unionByName(filled)


def distance(df: DataFrame) -> DataFrame:
    """``d``: L1 distance to the nearest pixel that is on; NULL in an image without one. ``df`` is dense.

    Four running windows; those that run backwards sort in descending order, so each costs one pass."""
    up, left = along_col(df), along_row(df)
    down = Window.partitionBy(*up_keys(df), "col").orderBy(F.desc("row"))
    right = Window.partitionBy(*up_keys(df), "row").orderBy(F.desc("col"))
    so_far = (Window.unboundedPreceding, 0)
    row = F.when(F.col("on") == 1, F.col("row"))
    df = df.withColumn("_a", F.col("row") - F.last(row, True).over(up.rowsBetween(*so_far)))
    df = df.withColumn("_v", F.least("_a", F.last(row, True).over(down.rowsBetween(*so_far)) - F.col("row")))
    df = df.withColumn("_l", F.col("col") + F.min(F.col("_v") - F.col("col")).over(left.rowsBetween(*so_far)))
    return df.withColumn("d", F.least("_l", F.min(F.col("_v") + F.col("col")).over(right.rowsBetween(*so_far)) - F.col("col"))).drop("_a", "_v", "_l")


def up_keys(df: DataFrame) -> list[str]:
    return ["image_id", *(c for c in ("channel",) if c in df.columns)]


def seeds(df: DataFrame, h: float = 0.05) -> DataFrame:
    """Components of the pixels nearer to what is on than all but ``h`` of the way.

    The distance is turned round, so that what is on has the greatest; seeds are therefore what
    is on and a margin around it. An image without pixels that are on has no seeds."""
    df = stage(distance(df))
    far = sized(df.groupBy(F.col("image_id").alias("_i")).agg(F.max("d").alias("_far")))
    near = df.join(far, F.col("image_id") == F.col("_i")).where(F.col("_far") + 1 - F.col("d") > (F.col("_far") + 1) * h)
    return components(near.select("image_id", "n_rows", "n_cols", "row", "col"))


def grow(labels: DataFrame, steps: int | None, allowed: DataFrame | None = None, more: int = 0) -> DataFrame:
    """Labels spread to unlabelled 4-neighbours, all at once in each of ``steps`` rounds.

    A pixel takes the most frequent label among its labelled neighbours, of several the least.
    ``allowed`` (``image_id, row, col``) holds the pixels that may be taken; ``steps`` None means
    as many rounds as the longer side of the image, and ``more``. Images of one tile are grown at once; the
    tiles of others exchange their margins every ``tiles.HALO`` rounds, until none changes."""
    rounds = F.greatest("n_rows", "n_cols") + more if steps is None else F.lit(steps)
    labels = labels.select("image_id", "n_rows", "n_cols", "row", "col", "label")
    state, seen = stage_observed(tiles.blocks(labels, rounds, allowed), left=F.count_if(F.col("changed") & (F.col("rounds") > 0)))
    while seen["left"]:
        # tiles of images that are done keep their state
        rest = state.where("rounds = 0")
        state, seen = stage_observed(tiles.grown(state.where("rounds > 0")).unionByName(rest.withColumn("changed", F.lit(False))), left=F.count_if(F.col("changed") & (F.col("rounds") > 0)))
    return tiles.labelled(state)


def relabel(labels: DataFrame) -> DataFrame:
    """Labels 1..k in the order of the old ones, of which only the distinct are ranked."""
    ranks = sized(ranked(labels.select(F.col("image_id").alias("_i"), F.col("label").alias("_old")).distinct(), "_i", "_old", "_new"))
    return labels.join(ranks, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_old"))).withColumn("label", F.col("_new")).drop("_i", "_old", "_new")


def filter_by_area(labels: DataFrame, min_area: int = 50, max_area: int = 5000) -> DataFrame:
    """Labels whose number of pixels is in the range (inclusive), relabelled."""
    sizes = labels.groupBy(F.col("image_id").alias("_i"), F.col("label").alias("_l")).agg(F.count("*").alias("_n")).where(F.col("_n").between(min_area, max_area))
    kept = sized(ranked(sizes, "_i", "_l", "_new"))
    return labels.join(kept, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_l"))).withColumn("label", F.col("_new")).drop("_i", "_l", "_n", "_new")
