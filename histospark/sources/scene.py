"""Rasters derived from ordinary tables, and images and masks given as arrays.

Relations: ``pixels(image_id, n_rows, n_cols, row, col, channel, value)`` is dense;
``labels(image_id, n_rows, n_cols, row, col, label)`` holds labels above 0 only. Rows and
columns count from 1. The size of the image stands in every row, where Parquet's run
lengths store it for nothing and no operator needs a join for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.operators import rasters, tiles

SIZE = 64
PER_IMAGE = 15


def scene_cells(customer: DataFrame) -> DataFrame:
    """Ellipses ``image_id, k, cr, cc, rx, ry``: fifteen customers an image, shape from the key."""
    key = F.col("c_custkey")
    number = lambda c: c.cast("int")
    return customer.select(
        F.expr(f"c_custkey div {PER_IMAGE}").cast("bigint").alias("image_id"),
        number(key % PER_IMAGE + 1).alias("k"),
        number(4 + (key * 37) % 57).alias("cr"),
        number(4 + (key * 53 + 11) % 57).alias("cc"),
        number(3 + key % 5).alias("rx"),
        number(3 + F.expr("c_custkey div 5") % 5).alias("ry"),
    )


def ellipse_labels(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Labels of the pixels within each ellipse; where ellipses overlap the last, i.e. greatest, stays.

    Each ellipse explodes into its own rows and columns, so nothing is compared with other images."""
    box = cells.select("image_id", "k", "cr", "cc", "rx", "ry", F.explode(F.sequence(F.greatest(F.lit(1), F.col("cr") - F.col("rx")), F.least(F.lit(size), F.col("cr") + F.col("rx")))).alias("row"))
    box = box.withColumn("col", F.explode(F.sequence(F.greatest(F.lit(1), F.col("cc") - F.col("ry")), F.least(F.lit(size), F.col("cc") + F.col("ry")))))
    dr, dc, rx, ry = F.col("row") - F.col("cr"), F.col("col") - F.col("cc"), F.col("rx"), F.col("ry")
    inside = box.where(dr * dr * ry * ry + dc * dc * rx * rx <= rx * rx * ry * ry)
    return inside.groupBy("image_id", F.lit(size).alias("n_rows"), F.lit(size).alias("n_cols"), "row", "col").agg(F.max("k").alias("label"))


def scene_images(customer: DataFrame) -> DataFrame:
    return scene_cells(customer).select("image_id").distinct().select("image_id", F.lit(SIZE).alias("n_rows"), F.lit(SIZE).alias("n_cols"))


def scene_labels(customer: DataFrame) -> DataFrame:
    return ellipse_labels(scene_cells(customer))


def predicted_labels(customer: DataFrame) -> DataFrame:
    """A second mask of the same scene: cells a row lower, flatter, and every seventh missing."""
    cells = scene_cells(customer).where("k % 7 <> 0").withColumns({"cr": F.col("cr") + 1, "rx": F.col("rx") - 1})
    return ellipse_labels(cells)


def shade(label: Column, channel: Column) -> Column:
    """A scene's value in thousandths: dark ground, cells by label and channel, and a texture."""
    cell = F.floor((600 + (label * 27) % 400) * (5 - channel) / 4)
    texture = (F.col("row") * 31 + F.col("col") * 17 + F.col("image_id") * 7) % 21 - 10
    return (F.when(label > 0, cell).otherwise(50) + texture).cast("int")


def scene_pixels(customer: DataFrame, channels: int = 1) -> DataFrame:
    """Dense pixels of the scene, ``channels`` of them (4 at most)."""
    df = tiles.dense(scene_labels(customer), scene_images(customer))
    df = df.withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(channels))) if channels > 1 else F.lit(1))
    return df.select("image_id", "n_rows", "n_cols", "row", "col", "channel", (shade(F.col("label"), F.col("channel")) / 1000).alias("value"))


def scene_rasters(customer: DataFrame, channels: int = 1) -> DataFrame:
    """The same pixels as rasters: an image is drawn from its ellipses at once, so only these are exchanged."""
    r, c = np.indices((SIZE, SIZE)) + 1

    def draw(image: int, cells: list[dict]) -> tuple:
        label = np.zeros((SIZE, SIZE), int)
        for x in cells:
            k, cr, cc, rx, ry = x.values()
            box = slice(max(0, cr - rx - 1), cr + rx), slice(max(0, cc - ry - 1), cc + ry)
            inside = (r[box] - cr) ** 2 * (ry * ry) + (c[box] - cc) ** 2 * (rx * rx) <= rx * rx * ry * ry
            label[box] = np.maximum(label[box], inside * k)
        texture = np.fmod(r * 31 + c * 17 + image * 7, 21) - 10
        a = np.stack([np.where(label > 0, (600 + label * 27 % 400) * (5 - k) // 4, 50) + texture for k in range(1, channels + 1)]) / 1000
        return rasters.packed(image, SIZE, SIZE, 0, 0, list(range(1, channels + 1)), a, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = batch.to_pylist()
            for i in range(0, len(images), 500):
                yield from rasters.table([draw(x["image_id"], x["cells"]) for x in images[i : i + 500]]).to_batches()

    images = scene_cells(customer).groupBy("image_id").agg(F.collect_list(F.struct("k", "cr", "cc", "rx", "ry")).alias("cells"))
    return images.mapInArrow(run, rasters.RASTERS)


#: The example scenes: number, ellipses, ground, least and greatest value and noise in thousandths, channels.
EXAMPLES = {
    "he_breast": (1, 20, 850, 200, 500, 20, ("H&E",)),
    "fluorescence_nuclei": (2, 15, 50, 600, 1000, 10, ("DAPI",)),
    "multiplex_4ch": (3, 18, 50, 300, 1000, 10, ("DAPI", "CD3", "CD8", "PanCK")),
}


def _example(kind: str) -> tuple:
    if kind not in EXAMPLES:
        raise ValueError(f"unknown example {kind}")
    return EXAMPLES[kind]


def example_labels(spark: SparkSession, kind: str) -> DataFrame:
    """The mask of an example scene of 64×64: ellipses by arithmetic, later ones over earlier."""
    image, n, *_ = _example(kind)
    k = F.col("k")
    number = lambda c: c.cast("int")
    cells = spark.range(1, n + 1).select(F.lit(image).cast("bigint").alias("image_id"), number(F.col("id")).alias("k"))
    cells = cells.select("image_id", "k", number(4 + (k * 37 + image * 29) % 57).alias("cr"), number(4 + (k * 53 + image * 3) % 57).alias("cc"), number(3 + (k + image) % 5).alias("rx"), number(3 + (k * 2 + image) % 5).alias("ry"))
    return ellipse_labels(cells)


def example_pixels(spark: SparkSession, kind: str) -> DataFrame:
    """The image of an example scene; a cell's value follows from its number and the channel."""
    image, _, ground, low, high, noise, names = _example(kind)
    frame = spark.range(1).select(F.lit(image).cast("bigint").alias("image_id"), F.lit(SIZE).alias("n_rows"), F.lit(SIZE).alias("n_cols"))
    df = tiles.dense(example_labels(spark, kind), frame)
    df = df.withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    inside = low + (F.col("label") * 97 + F.col("channel") * 41) % (high - low + 1)
    texture = F.floor(((F.col("row") * 31 + F.col("col") * 17 + F.col("channel") * 7) % 21 - 10) * noise / 10)
    value = F.when(F.col("label") > 0, inside).otherwise(ground) + texture
    return df.select("image_id", "n_rows", "n_cols", "row", "col", "channel", (F.least(F.greatest(value, F.lit(0)), F.lit(1000)) / 1000).alias("value"))


IMAGES = "image_id bigint, n_rows int, n_cols int, n_channels int, channels array<string>, resolution struct<x_um: double, y_um: double>, metadata map<string, string>, history array<string>"


def example_images(spark: SparkSession) -> DataFrame:
    """What is known of the example scenes, a row each."""
    rows = [(image, SIZE, SIZE, len(names), list(names), (None, None), {"type": kind, "synthetic": "true"}, []) for kind, (image, *_, names) in EXAMPLES.items()]
    return spark.createDataFrame(rows, IMAGES)


def described(spark: SparkSession, arrays: dict[int, np.ndarray], channels: dict[int, list[str]] | None = None, resolution: dict[int, tuple[float, float]] | None = None, metadata: dict[int, dict[str, str]] | None = None) -> DataFrame:
    """The ``images`` rows of arrays: sizes, channel names (``ch1 ..`` by default), pixel sizes and metadata; no history."""
    rows = []
    for image, a in arrays.items():
        n = 1 if np.ndim(a) == 2 else np.shape(a)[2]
        names = (channels or {}).get(image) or [f"ch{k + 1}" for k in range(n)]
        if len(names) != n:
            raise ValueError(f"image {image} has {n} channels and {len(names)} names")
        rows.append((image, *np.shape(a)[:2], n, names, (resolution or {}).get(image) or (None, None), (metadata or {}).get(image) or {}, []))
    return spark.createDataFrame(rows, IMAGES)


def embedding_pixels(embeddings: DataFrame, rows: int = 64) -> DataFrame:
    """Vectors as rasters: 64 vectors an image, a vector a row."""
    df = embeddings.select(F.expr(f"vec_id div {rows}").cast("bigint").alias("image_id"), (F.col("vec_id") % rows + 1).cast("int").alias("row"), F.size("embedding").alias("n_cols"), F.posexplode("embedding"))
    size = embeddings.groupBy(F.expr(f"vec_id div {rows}").cast("bigint").alias("image_id")).agg(F.max(F.col("vec_id") % rows + 1).cast("int").alias("n_rows"))
    df = df.select("image_id", "n_cols", "row", (F.col("pos") + 1).alias("col"), F.lit(1).alias("channel"), F.col("col").cast("double").alias("value"))
    return df.join(size, "image_id").select("image_id", "n_rows", "n_cols", "row", "col", "channel", "value")


def pixels_from_arrays(spark: SparkSession, arrays: dict[int, np.ndarray]) -> DataFrame:
    """Dense pixels of two- or three-dimensional numeric arrays (rows, columns, channels)."""
    parts = []
    for image, a in arrays.items():
        a = np.asarray(a)
        if a.ndim not in (2, 3) or not np.issubdtype(a.dtype, np.number):
            raise ValueError("an image must be a numeric array of two or three dimensions")
        a = a.reshape(a.shape[0], a.shape[1], -1).astype(float)
        r, c, k = np.indices(a.shape)
        parts.append(pd.DataFrame({"image_id": image, "n_rows": a.shape[0], "n_cols": a.shape[1], "row": r.ravel() + 1, "col": c.ravel() + 1, "channel": k.ravel() + 1, "value": a.ravel()}))
    return spark.createDataFrame(pd.concat(parts), "image_id bigint, n_rows int, n_cols int, row int, col int, channel int, value double")


def labels_from_arrays(spark: SparkSession, arrays: dict[int, np.ndarray]) -> DataFrame:
    """Sparse labels of two-dimensional arrays; values are truncated to whole numbers."""
    parts = []
    for image, a in arrays.items():
        a = np.asarray(a)
        if a.ndim != 2:
            raise ValueError("a mask must be an array of two dimensions")
        a = np.trunc(np.nan_to_num(a.astype(float))).astype(int)
        r, c = np.nonzero(a > 0)
        parts.append(pd.DataFrame({"image_id": image, "n_rows": a.shape[0], "n_cols": a.shape[1], "row": r + 1, "col": c + 1, "label": a[r, c]}))
    return spark.createDataFrame(pd.concat(parts), "image_id bigint, n_rows int, n_cols int, row int, col int, label int")


def mask_summary(labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """``image_id, n_rows, n_cols, n_cells``: the greatest label, 0 for images of ``masks`` without labels."""
    if masks is None:
        return labels.groupBy("image_id", "n_rows", "n_cols").agg(F.max("label").alias("n_cells"))
    most = labels.groupBy("image_id").agg(F.max("label").alias("n_cells"))
    return masks.select("image_id", "n_rows", "n_cols").join(most, "image_id", "left").fillna(0, ["n_cells"])
