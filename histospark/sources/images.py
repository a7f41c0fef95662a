"""Image files as pixels, and masks as files."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyarrow import NativeFile
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.functions import rasterfiles
from histospark.operators import measure

#: Rows of an image that are sent to the JVM at a time.
ROWS = 256
_LOCAL = "file:"


_OWN, _JVM = r"\.(pgm|ppm|pnm|png|tiff?)$", r"\.(jpe?g|bmp|gif)$"
_PIXELS = "image_id bigint, path string, n_rows int, n_cols int, row int, col int, channel int, value double"


def _rows(image: int, path: str, a: np.ndarray) -> Iterator[pd.DataFrame]:
    for r0 in range(0, a.shape[0], ROWS):
        part = a[r0 : r0 + ROWS]
        r, c, k = np.indices(part.shape)
        yield pd.DataFrame({"image_id": image, "path": path, "n_rows": a.shape[0], "n_cols": a.shape[1], "row": r.ravel() + r0 + 1, "col": c.ravel() + 1, "channel": k.ravel() + 1, "value": part.ravel()})


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the image files at ``path`` (a file, folder or pattern), with ``path``.

    Arrays are always rows by columns; ``image_id`` is a hash of the path; channels count from 1.
    PNM, PNG and TIFF are decoded here, JPEG, BMP and GIF (8 bits) by the JVM. Files of another
    ending are an error, as damaged ones are."""
    if "://" not in path and not any(c in path for c in "*?[{") and not os.path.exists(path.removeprefix(_LOCAL)):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").load(path)
    kinds = files.select(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("kind"), F.lower("path").rlike(_OWN).alias("own"), F.lower("path").rlike(_JVM).alias("jvm")).distinct().collect()  # endings
    if odd := sorted(k.kind for k in kinds if not k.own and not k.jvm):
        raise ValueError(f"image files can't end in {', '.join(odd)}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, image, content in zip(f["path"], f["image_id"], f["content"]):
                yield from _rows(image, path, rasterfiles.decode(bytes(content)))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, image, h, w, n, content in zip(f["path"], f["image_id"], f["height"], f["width"], f["nChannels"], f["data"]):
                a = np.frombuffer(bytes(content), np.uint8).reshape(h, w, n)
                # the JVM gives blue first
                yield from _rows(image, path, (a[..., [2, 1, 0, *range(3, n)]] if n >= 3 else a) / 255.0)

    out = files.where(F.lower("path").rlike(_OWN)).select("path", F.xxhash64("path").alias("image_id"), "content").mapInPandas(run, _PIXELS)
    if not any(k.jvm for k in kinds):
        return out
    pictures = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").where(F.lower("origin").rlike(_JVM))
    pictures = pictures.select(F.col("origin").alias("path"), F.xxhash64("origin").alias("image_id"), "height", "width", "nChannels", F.when(F.col("height") > 0, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("damaged image "), "origin"))).alias("data"))
    return out.unionByName(pictures.mapInPandas(unpack, _PIXELS))


def to_array(pixels: pd.DataFrame, value: str = "value") -> np.ndarray:
    """Dense array of one image's rows."""
    h, w = int(pixels["n_rows"].iloc[0]), int(pixels["n_cols"].iloc[0])
    c = int(pixels["channel"].max()) if "channel" in pixels else 1
    a = np.zeros((h, w, c), pixels[value].dtype)
    a[pixels["row"] - 1, pixels["col"] - 1, pixels["channel"] - 1 if "channel" in pixels else 0] = pixels[value]
    return a


def mask_rasters(labels: DataFrame, kind: str) -> DataFrame:
    """``image_id, content``: a PNG of colours, or a 16-bit TIFF of labels over the greatest label.

    An image is one file and so must fit in a task."""
    if kind not in ("png", "tiff"):
        raise ValueError(f"unknown raster {kind}")

    def of(f: pd.DataFrame) -> pd.DataFrame:
        a = to_array(f.assign(label=f["label"].astype(np.int64)), "label")[..., 0]
        data = rasterfiles.encode_png(rasterfiles.label_colours(a)) if kind == "png" else rasterfiles.encode_tiff(a / max(1, a.max()))
        return pd.DataFrame({"image_id": [f["image_id"].iloc[0]], "content": [data]})

    return labels.select("image_id", "n_rows", "n_cols", "row", "col", "label").groupBy("image_id").applyInPandas(of, "image_id bigint, content binary")


def cell_csv(labels: DataFrame) -> DataFrame:
    """A row per cell: shape, centroid, bounding box, and the cell's number last."""
    m = measure.morphology(labels)
    return m.select("image_id", "area", "perimeter", "circularity", "eccentricity", "solidity", "centroid_row", "centroid_col", "bbox_row_min", "bbox_row_max", "bbox_col_min", "bbox_col_max", F.col("label").alias("cell_id"))


def geojson_features(labels: DataFrame, qupath: bool = False, simplify: bool = False, tolerance: float = 1.0) -> DataFrame:
    """``image_id, cell_id, feature``: a GeoJSON polygon of each cell, rings as arrays of [x, y]."""
    polys = measure.polygons(labels, simplify, tolerance)
    coordinates = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    if qupath:
        name = F.concat(F.lit("cell-"), F.col("label").cast("string"))
        properties = F.struct(F.lit("detection").alias("objectType"), F.struct(F.lit("Cell").alias("name")).alias("classification"), F.col("label").alias("cellID"))
        feature = F.struct(F.lit("Feature").alias("type"), name.alias("id"), geometry.alias("geometry"), properties.alias("properties"))
    else:
        feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("label").alias("cell_id")).alias("properties"))
    return polys.select("image_id", F.col("label").alias("cell_id"), F.to_json(feature).alias("feature"))


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


@contextmanager
def _written(folder: str, name: str) -> Iterator[NativeFile]:
    """A file of a shared file system, under another name until it is whole: a task that is lost or run twice leaves no half a file."""
    fs, at = FileSystem.from_uri(folder if "//" in folder else folder.replace("file:", "file://", 1))
    fs.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, f"{at}/{name}")


def export_mask(labels: DataFrame, path: str, kind: str = "tiff") -> str:
    """Write masks to the folder ``path``: ``csv`` by rows, the others one file an image.

    Executors write to the file system that ``path`` names (or the session's own), which they
    must share. Collections of polygons are streamed, so an image's don't have to fit in memory.
    Returns the path."""
    target = _qualified(labels.sparkSession, path)
    if kind == "csv":
        cell_csv(labels).write.mode("overwrite").csv(path, header=True)
    elif kind in ("geojson", "qupath"):

        def stream(rows) -> None:
            for image, own in itertools.groupby(rows, key=lambda r: r.image_id):
                with _written(target, f"{image}.geojson") as out:
                    out.write(b'{"type":"FeatureCollection","features":[')
                    for k, r in enumerate(own):
                        out.write((",\n" if k else "").encode() + r.feature.encode())
                    out.write(b"]}")

        geojson_features(labels, kind == "qupath").repartition("image_id").sortWithinPartitions("image_id", "cell_id").foreachPartition(stream)
    elif kind in ("png", "tiff"):
        ending = "png" if kind == "png" else "tif"

        def save(rows) -> None:
            for r in rows:
                with _written(target, f"{r.image_id}.{ending}") as out:
                    out.write(bytes(r.content))

        mask_rasters(labels, kind).foreachPartition(save)
    else:
        raise ValueError(f"unknown format {kind}")
    return path
