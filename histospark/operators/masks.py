"""Filtering, merging and correcting masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histospark.operators.labeling import grow, relabel
from histospark.operators.measure import CELL, moments
from histospark.operators.stencil import on_edge
from histospark.runtime import same_size, stage

_COLUMNS = ["image_id", "n_rows", "n_cols", "row", "col", "label"]


def edge_cells(labels: DataFrame) -> DataFrame:
    """``image_id, label`` of the cells that touch their image's edge."""
    return labels.where(on_edge()).select(*CELL).distinct()


def passing(labels: DataFrame, min_area: float = 50, max_area: float = 5000, min_circularity: float = 0.3, max_eccentricity: float = 0.95) -> DataFrame:
    """Cells whose shape is in the ranges (inclusive); an undefined measure passes."""
    m = moments(labels)
    round_ = F.col("circularity").isNull() | (F.col("circularity") >= min_circularity)
    flat = F.col("eccentricity").isNull() | (F.col("eccentricity") <= max_eccentricity)
    return m.where(F.col("area").between(min_area, max_area) & round_ & flat).select(*CELL)


def filter_cells(labels: DataFrame, border_cells: str = "keep", **ranges: float) -> DataFrame:
    """Labels of the cells that pass, relabelled; ``remove`` also drops those on the edge.

    With ``flag`` edge cells stay; ``edge_cells`` gives their old labels."""
    if border_cells not in ("keep", "remove", "flag"):
        raise ValueError(f"unknown treatment of border cells {border_cells}")
    kept = passing(labels, **ranges)
    if border_cells == "remove":
        kept = kept.join(edge_cells(labels), CELL, "left_anti")
    return relabel(labels.join(kept, CELL, "left_semi"))


def merge_assign(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """Nuclei under the label of the cell they overlap most, of several the least; others are dropped. Masks of different sizes are an error."""
    at = ["image_id", "row", "col"]
    of_cell = cells.select(*at, F.col("label").alias("_cell"), F.col("n_rows").alias("c_rows"), F.col("n_cols").alias("c_cols"))
    overlap = nuclei.withColumnsRenamed({"n_rows": "p_rows", "n_cols": "p_cols"}).join(of_cell, at).withColumn("_cell", same_size("p", "c", F.col("_cell"))).groupBy("image_id", F.col("label").alias("_nucleus"), "_cell").agg(F.count("*").alias("_n"))
    best = overlap.groupBy(F.col("image_id").alias("_i"), "_nucleus").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_cell").alias("cell")))["cell"].alias("_to"))
    return nuclei.join(best, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_nucleus"))).withColumn("label", F.col("_to")).select(*_COLUMNS)


def merge_expand(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """Nuclei grown within the cells; masks of different sizes are an error."""
    sizes = nuclei.groupBy("image_id").agg(F.max("n_rows").alias("p_rows"), F.max("n_cols").alias("p_cols"))
    within = cells.withColumnsRenamed({"n_rows": "c_rows", "n_cols": "c_cols"}).join(sizes, "image_id")
    return grow(nuclei, None, within.select("image_id", same_size("p", "c", F.col("row")).alias("row"), "col"))


def apply_corrections(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections ``image_id, seq, action, cell_id, cell_ids, points`` in the order of ``seq``.

    ``delete`` and ``merge`` change labels alone: consecutive ones are chained into one mapping.
    ``add`` gives its points, ``split`` the cell's pixels nearest its points, new labels that
    overwrite others; points outside the image are ignored. Labels are made 1..k at the end.
    A step holds one ``seq`` of all images, so the number of steps is the longest list."""
    bad = corrections.where(~F.coalesce(F.col("action").isin("delete", "merge", "split", "add"), F.lit(False)) | ((F.col("action") == "merge") & (F.coalesce(F.size("cell_ids"), F.lit(0)) < 2)) | (F.col("action").isin("delete", "split") & F.col("cell_id").isNull()) | (F.col("action").isin("split", "add") & F.col("points").isNull()))
    if not bad.isEmpty():
        raise ValueError("malformed corrections")
    ordered = stage(corrections.withColumn("_step", F.row_number().over(Window.partitionBy("image_id").orderBy("seq"))))
    steps = ordered.agg(F.max("_step")).first()[0] or 0
    at = ["image_id", "row", "col"]
    current = labels.select(*_COLUMNS)
    frames = stage(current.select("image_id", "n_rows", "n_cols").distinct())
    for k in range(1, steps + 1):
        step = ordered.where(F.col("_step") == k)
        kinds = {r.action for r in step.select("action").distinct().collect()}
        if kinds & {"delete", "merge"}:
            mapping = step.where("action in ('delete', 'merge')").select(
                F.col("image_id").alias("_i"), F.explode(F.when(F.col("action") == "delete", F.array("cell_id")).otherwise(F.col("cell_ids"))).alias("_old"), F.when(F.col("action") == "merge", F.col("cell_ids")[0]).alias("_new"), F.lit(True).alias("_hit")
            )
            mapping = mapping.dropDuplicates(["_i", "_old"])
            current = current.join(mapping, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_old")), "left")
            current = current.withColumn("label", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("label"))).where("label is not null").select(*_COLUMNS)
        if kinds & {"add", "split"}:
            current = stage(current)
            top = current.groupBy(F.col("image_id").alias("_i")).agg(F.max("label").alias("_top"))
            marks = step.where("action in ('add', 'split')").select("image_id", "action", "cell_id", F.posexplode("points").alias("_s", "_p"))
            marks = marks.join(frames, "image_id").join(top, F.col("image_id") == F.col("_i"), "left")
            new = F.coalesce("_top", F.lit(0)) + F.when(F.col("action") == "split", F.col("_s") + 1).otherwise(1)
            marks = marks.select("image_id", "n_rows", "n_cols", F.col("_p.row").alias("row"), F.col("_p.col").alias("col"), new.cast("int").alias("label"), "action", "cell_id").where("row between 1 and n_rows and col between 1 and n_cols")
            marks = stage(marks.groupBy("image_id", "n_rows", "n_cols", "row", "col", "action", "cell_id").agg(F.max("label").alias("label")))
            split = step.where("action = 'split'").select(F.col("image_id").alias("_i"), F.col("cell_id").alias("_c"))
            within = current.join(split, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_c")), "left_semi")
            grown = grow(marks.where("action = 'split'").select(*_COLUMNS), None, within)
            painted = marks.where("action = 'add'").select(*_COLUMNS).unionByName(grown)
            rest = current.join(split, (F.col("image_id") == F.col("_i")) & (F.col("label") == F.col("_c")), "left_anti")
            current = stage(rest.join(painted.select(*at), at, "left_anti").unionByName(painted))
    return relabel(current)
