"""What is printed of images, masks, evaluations, tasks and loops: a row of text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.operators import measure


def _fixed(c: Column, places: int) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", F.floor(c * 10.0**places + 0.5) / 10.0**places))


def image_lines(images: DataFrame) -> DataFrame:
    """``image_id, text``: size and channels, pixel size where it is set, and history where there is one."""
    size = F.concat_ws(" x ", F.col("n_rows").cast("string"), F.col("n_cols").cast("string"))
    names = F.array_join(F.coalesce("channels", F.array().cast("array<string>")), ", ")
    first = F.when(F.col("n_channels") == 1, F.concat(size, F.lit(" (1 channel)"))).otherwise(F.concat(size, F.lit(" x "), F.col("n_channels").cast("string"), F.lit(" ("), F.col("n_channels").cast("string"), F.lit(" channels: "), names, F.lit(")")))
    x, y = F.col("resolution.x_um"), F.col("resolution.y_um")
    resolution = F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.lit("Resolution: "), _fixed(x, 6), F.lit(" x "), F.coalesce(_fixed(y, 6), F.lit("NA")), F.lit(" um/px")))
    history = F.when(F.size("history") > 0, F.concat(F.lit("History: "), F.array_join("history", " -> ")))
    return images.select("image_id", F.concat_ws("; ", first, resolution, history).alias("text"))


def mask_lines(masks: DataFrame) -> DataFrame:
    """``image_id, text``: size, number of cells, and method where it is known."""
    cells = F.concat(F.col("n_cells").cast("string"), F.when(F.col("n_cells") == 1, " cell").otherwise(" cells"))
    first = F.concat(F.col("n_rows").cast("string"), F.lit(" x "), F.col("n_cols").cast("string"), F.lit(", "), cells)
    method = F.col("model_info")["method"]
    return masks.select("image_id", F.concat_ws("; ", first, F.when(method.isNotNull(), F.concat(F.lit("Method: "), method))).alias("text"))


def mask_summary_lines(labels: DataFrame) -> DataFrame:
    """``image_id, text``: number of cells present and their least, median and greatest area; empty masks have no row."""
    s = measure.area_summary(labels)
    text = F.concat(F.col("n").cast("string"), F.lit(" cells; area min: "), F.col("min_area").cast("string"), F.lit(", median: "), _fixed(F.col("median_area"), 1), F.lit(", max: "), F.col("max_area").cast("string"))
    return s.select("image_id", text.alias("text"))


def evaluation_lines(metrics: DataFrame) -> DataFrame:
    """``image_id, metric, text``: metrics at four places."""
    return metrics.select("image_id", "metric", F.concat("metric", F.lit(": "), F.coalesce(_fixed(F.col("value"), 4), F.lit("NA"))).alias("text"))


def task_lines(tasks: DataFrame) -> DataFrame:
    """``task_id, image_id, text``: number and size of a task's patches."""
    side = F.col("patch_size").cast("string")
    return tasks.select("task_id", "image_id", F.concat(F.lit("Patches: "), F.col("n_patches").cast("string"), F.lit(" ("), side, F.lit(" x "), side, F.lit(" px)")).alias("text"))


def loop_lines(rounds: DataFrame) -> DataFrame:
    """``image_id, text``: rounds of active learning, the model used and all patches."""
    s = rounds.groupBy("image_id", "model").agg(F.max("round").alias("n"), F.count("*").alias("p"))
    return s.select("image_id", F.concat(F.lit("Rounds: "), F.col("n").cast("string"), F.lit("; Model: "), "model", F.lit("; Total patches: "), F.col("p").cast("string")).alias("text"))
