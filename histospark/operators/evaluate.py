"""Quality of a predicted mask against the truth, per image.

Everything follows from one join of the masks' pixels: overlaps are counted for the pairs
that have any, never for all pairs of cells. Numbers of cells are greatest labels, so that
gaps among labels count as cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.runtime import over, same_size

METRICS = ("dice", "jaccard", "aji", "panoptic_quality", "ap50", "ap75", "f1_detection")
_AT = ["image_id", "row", "col"]


def overlaps(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``image_id, pred, gt, inter, pred_area, gt_area, iou`` of the pairs of cells that overlap."""
    inter = predicted.select(*_AT, F.col("label").alias("pred")).join(truth.select(*_AT, F.col("label").alias("gt")), _AT).groupBy("image_id", "pred", "gt").agg(F.count("*").alias("inter"))
    size = lambda df, name: df.groupBy("image_id", F.col("label").alias(name)).agg(F.count("*").alias(f"{name}_area"))
    out = inter.join(size(predicted, "pred"), ["image_id", "pred"]).join(size(truth, "gt"), ["image_id", "gt"])
    return out.withColumn("iou", F.col("inter") / (F.col("pred_area") + F.col("gt_area") - F.col("inter")))


def _count(df: DataFrame, name: str, *more: Column) -> DataFrame:
    return df.groupBy(F.col("image_id").alias(f"_{name}")).agg(F.count("*").alias(f"{name}_px"), F.max("label").alias(f"{name}_n"), F.max("n_rows").alias(f"{name}_rows"), F.max("n_cols").alias(f"{name}_cols"), *more)


def evaluate(predicted: DataFrame, truth: DataFrame, images: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``image_id, metric, value`` of every image of ``images`` (``image_id``); masks of different sizes are an error."""
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    o = overlaps(predicted, truth)
    base = images.select("image_id").distinct()
    for df, name in ((predicted, "p"), (truth, "g")):
        base = base.join(_count(df, name), F.col("image_id") == F.col(f"_{name}"), "left").drop(f"_{name}")
    common = o.groupBy("image_id").agg(F.sum("inter").alias("both"))
    sized = ["p_rows", "p_cols", "g_rows", "g_cols"]
    out = base.join(common, "image_id", "left")
    out = out.fillna(0, [c for c in out.columns if c not in sized])
    if set(metrics) - {"dice", "jaccard"}:
        # best prediction of each true cell, of several the least; and the reverse
        gt = o.groupBy("image_id", "gt").agg(F.max(F.struct("iou", (-F.col("pred")).alias("p"), "inter", "pred_area", "gt_area")).alias("b"))
        gt = gt.select("image_id", "gt", F.col("b.iou").alias("iou"), (-F.col("b.p")).alias("pred"), F.col("b.inter").alias("inter"), F.col("b.pred_area").alias("pred_area"), F.col("b.gt_area").alias("gt_area"))
        used = gt.groupBy("image_id", "pred").agg(F.first("pred_area").alias("a")).groupBy("image_id").agg(F.sum("a").alias("used_px"))
        aji = gt.groupBy("image_id").agg(F.sum("inter").alias("aji_i"), F.sum(F.col("pred_area") + F.col("gt_area") - F.col("inter")).alias("aji_u"), F.sum("gt_area").alias("met_px"))
        # a prediction that two true cells choose counts for the first
        pq = gt.where("iou > 0.5").groupBy("image_id", "pred").agg(F.min(F.struct("gt", "iou")).alias("m")).groupBy("image_id").agg(F.count("*").alias("pq_tp"), F.sum("m.iou").alias("pq_iou"))
        pred = o.groupBy("image_id", "pred").agg(F.max(F.struct("iou", (-F.col("gt")).alias("g"))).alias("b"))
        found = pred.groupBy("image_id").agg(*[F.countDistinct(F.when(F.col("b.iou") >= t, F.col("b.g"))).alias(f"tp{round(t * 100)}") for t in (0.5, 0.75)])
        for df in (used, aji, pq, found):
            out = out.join(df, "image_id", "left")
        out = out.fillna(0, [c for c in out.columns if c not in sized])
    p_px, g_px, both, p, g = (F.col(c) for c in ("p_px", "g_px", "both", "p_n", "g_n"))

    def instances(value: Column) -> Column:
        return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).otherwise(value)

    def f1(tp: Column) -> Column:
        precision, recall = over(tp, p.cast("double")), over(tp, g.cast("double"))
        return F.when(tp > 0, over(2 * precision * recall, precision + recall)).otherwise(0.0)

    def value(m: str) -> Column:
        if m == "dice":
            return F.when(p_px + g_px > 0, over(2 * both, (p_px + g_px).cast("double"))).otherwise(1.0)
        if m == "jaccard":
            return F.when(p_px + g_px > 0, over(both, (p_px + g_px - both).cast("double"))).otherwise(1.0)
        if m == "aji":
            return instances(over(F.col("aji_i"), (F.col("aji_u") + (g_px - F.col("met_px")) + (p_px - F.col("used_px"))).cast("double")))
        if m == "panoptic_quality":
            tp = F.col("pq_tp")
            return instances(F.when(tp > 0, over(F.col("pq_iou"), tp + 0.5 * (p - tp) + 0.5 * (g - tp))).otherwise(0.0))
        return instances(f1(F.col("tp75" if m == "ap75" else "tp50")))

    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), same_size("p", "g", value(m)).alias("value")) for m in METRICS if m in metrics])
    return out.select("image_id", F.explode(pairs).alias("m")).select("image_id", "m.metric", "m.value")
