"""Patches for annotation, ranked by how uncertain a mask is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _starts(count: Column, most: Column) -> Column:
    """``count`` (at most ``most``) whole starts, evenly from 1 to ``most``, halves to even."""
    n = F.least(count, most)
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.bround(1 + i * (most - 1) / F.greatest(n - 1, F.lit(1))).cast("int"))


def _drawn(seed: int, axis: str, n: int, most: Column) -> Column:
    """``n`` pseudorandom starts from 1 to ``most``: all different if there are as many, else any."""
    of = lambda i: F.xxhash64(F.lit(seed), F.lit(axis), F.col("image_id"), i)
    order = F.array_sort(F.transform(F.sequence(F.lit(1), most), lambda i: F.struct(of(i).alias("h"), i.cast("int").alias("i"))))
    any_ = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.pmod(of(i), most) + 1).cast("int"))
    return F.when(most >= n, F.transform(F.slice(order, 1, n), lambda s: s["i"])).otherwise(any_)


def patch_random(images: DataFrame, n: int = 20, size: int = 256, seed: int = 1) -> DataFrame:
    """``n`` patches of each image at pseudorandom places; the same for the same seed."""
    h, w = F.col("n_rows"), F.col("n_cols")
    most = lambda c: F.greatest(F.lit(1), c - size + 1)
    starts = F.arrays_zip(_drawn(seed, "row", n, most(h)).alias("row_start"), _drawn(seed, "col", n, most(w)).alias("col_start"))
    df = images.select("image_id", "n_rows", "n_cols", F.posexplode(starts).alias("_k", "s")).select("image_id", "n_rows", "n_cols", (F.col("_k") + 1).alias("patch_id"), F.col("s.row_start").alias("row_start"), F.col("s.col_start").alias("col_start"))
    return df.select("image_id", "patch_id", "row_start", F.least(F.col("row_start") + size - 1, "n_rows").alias("row_end"), "col_start", F.least(F.col("col_start") + size - 1, "n_cols").alias("col_end"))


def patch_grid(images: DataFrame, n: int = 20, size: int = 256) -> DataFrame:
    """``image_id, patch_id, row_start, row_end, col_start, col_end``: at most ``n`` patches of each image.

    Starts lie on a grid whose row number runs fastest; larger patches than images are cut."""
    h, w = F.col("n_rows"), F.col("n_cols")
    df = images.select("image_id", "n_rows", "n_cols", F.greatest(F.lit(1), h - size + 1).alias("_h"), F.greatest(F.lit(1), w - size + 1).alias("_w"), F.ceil(F.sqrt(n * h / w)).alias("_r"))
    df = df.withColumn("_c", F.ceil(F.lit(n) / F.col("_r")))
    df = df.select("image_id", "n_rows", "n_cols", F.posexplode(_starts(F.col("_c"), F.col("_w"))).alias("_j", "col_start"), _starts(F.col("_r"), F.col("_h")).alias("_rows"))
    df = df.select("image_id", "n_rows", "n_cols", "_j", "col_start", F.size("_rows").alias("_k"), F.posexplode("_rows").alias("_i", "row_start"))
    df = df.withColumn("patch_id", (F.col("_j") * F.col("_k") + F.col("_i") + 1).cast("int")).where(F.col("patch_id") <= n)
    return df.select("image_id", "patch_id", "row_start", F.least(F.col("row_start") + size - 1, "n_rows").alias("row_end"), "col_start", F.least(F.col("col_start") + size - 1, "n_cols").alias("col_end"))


def uncertainty(labels: DataFrame, patches: DataFrame, size: int) -> DataFrame:
    """``patches`` with ``score``: of a patch's inner labelled pixels, the share beside another label or none.

    A patch is cut into tiles of its own size, at most four, so pixels and patches meet by equal
    tile numbers; a pixel's neighbours in its patch are those of the image, for it lies inside."""
    from histospark.operators.stencil import neighbours

    tile = lambda c: F.floor((c - 1) / size)
    px = neighbours(labels).select("image_id", "row", "col", (F.col("n_same") < 4).alias("_b"), tile(F.col("row")).alias("_tr"), tile(F.col("col")).alias("_tc"))
    cover = patches.select("image_id", "patch_id", "row_start", "row_end", "col_start", "col_end", F.explode(F.sequence(tile(F.col("row_start")), tile(F.col("row_end")))).alias("_tr"))
    cover = cover.withColumn("_tc", F.explode(F.sequence(tile(F.col("col_start")), tile(F.col("col_end")))))
    inner = px.join(cover, ["image_id", "_tr", "_tc"]).where("row > row_start and row < row_end and col > col_start and col < col_end")
    scores = inner.groupBy("image_id", "patch_id").agg(F.avg(F.col("_b").cast("double")).alias("score"))
    return patches.join(scores, ["image_id", "patch_id"], "left").fillna(0.0, ["score"])


def annotation_task(images: DataFrame, labels: DataFrame | None = None, region: tuple[int, int, int, int] | None = None, n_patches: int = 20, patch_size: int = 256) -> DataFrame:
    """Patches of each image, in order ``rank``; with a mask, those of the highest scores first.

    ``region`` (first and last row and column) cuts the image; patches then count from its corner,
    and are scored where they lie in the mask."""
    if region is not None:
        if len(region) != 4:
            raise ValueError("region must be first and last row, first and last column")
        images = images.select("image_id", F.lit(region[1] - region[0] + 1).alias("n_rows"), F.lit(region[3] - region[2] + 1).alias("n_cols"))
    patches = patch_grid(images, n_patches, patch_size)
    if labels is None:
        return patches.withColumns({"score": F.lit(None).cast("double"), "rank": F.col("patch_id")})
    if region is not None:
        labels = labels.where(F.col("row").between(region[0], region[1]) & F.col("col").between(region[2], region[3])).withColumns({"row": F.col("row") - region[0] + 1, "col": F.col("col") - region[2] + 1})
    scored = uncertainty(labels, patches, patch_size)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "patch_id")))


def active_rounds(task: DataFrame, n_rounds: int, model: str = "cellpose") -> DataFrame:
    """The same patches for each of ``n_rounds`` rounds; nothing is trained between them."""
    return task.select(F.explode(F.sequence(F.lit(1), F.lit(n_rounds))).alias("round"), F.lit(model).alias("model"), "*")


def training_pairs(pixels: DataFrame, labels: DataFrame, patches: DataFrame, size: int) -> DataFrame:
    """``image_id, patch_id, row, col, channel, value, label``: pixels and labels of patches, counted from their corners; label 0 for none.

    ``size`` is the side of the patches."""
    tile = lambda c: F.floor((c - 1) / size)
    cover = patches.select("image_id", "patch_id", "row_start", "row_end", "col_start", "col_end", F.explode(F.sequence(tile(F.col("row_start")), tile(F.col("row_end")))).alias("_tr"))
    cover = cover.withColumn("_tc", F.explode(F.sequence(tile(F.col("col_start")), tile(F.col("col_end")))))
    both = pixels.select("image_id", "row", "col", "channel", "value").join(labels.select("image_id", "row", "col", "label"), ["image_id", "row", "col"], "left").fillna(0, ["label"])
    both = both.withColumns({"_tr": tile(F.col("row")), "_tc": tile(F.col("col"))}).join(cover, ["image_id", "_tr", "_tc"]).where("row between row_start and row_end and col between col_start and col_end")
    return both.select("image_id", "patch_id", (F.col("row") - F.col("row_start") + 1).alias("row"), (F.col("col") - F.col("col_start") + 1).alias("col"), "channel", "value", "label")
