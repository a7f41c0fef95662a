"""Relations behind plots; drawing is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.operators.measure import CELL
from histospark.operators.stencil import border


def outlines(labels: DataFrame, highlight: list[int] | None = None) -> DataFrame:
    """Border pixels of all or the highlighted cells."""
    df = border(labels).where("is_border")
    return (df if highlight is None else df.where(F.col("label").isin(highlight))).select("image_id", "row", "col", "label")


def centroids(labels: DataFrame, highlight: list[int] | None = None) -> DataFrame:
    df = labels if highlight is None else labels.where(F.col("label").isin(highlight))
    return df.groupBy(*CELL).agg(F.avg("row").alias("row"), F.avg("col").alias("col"))


def coloured(labels: DataFrame, features: DataFrame, column: str) -> DataFrame:
    """Every labelled pixel with a feature of its cell."""
    f = features.select("image_id", F.col("cell_id").alias("label"), F.col(column).cast("double").alias("value"))
    return labels.select("image_id", "row", "col", "label").join(f, CELL, "left")


def overlay(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pixel's value with its label, NULL for none."""
    return pixels.select("image_id", "row", "col", "channel", "value").join(labels.select("image_id", "row", "col", "label"), ["image_id", "row", "col"], "left")


def feature_points(features: DataFrame, x: str, y: str) -> DataFrame:
    return features.select("image_id", "cell_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def comparison(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pixels of both masks under the name of their panel."""
    side = lambda df, name: df.select("image_id", "row", "col", "label", F.lit(name).alias("panel"))
    return side(predicted, "predicted").unionByName(side(truth, "truth"))


def metric_bars(metrics: DataFrame) -> DataFrame:
    """Metrics of an image from the least to the greatest, by ``place``."""
    from pyspark.sql import Window

    return metrics.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("value", "metric")))
