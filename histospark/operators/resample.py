"""Bilinear resampling as one join of targets' corners with their pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.operators.stencil import keys


def scaled(n: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n * scale).cast("int"))


def resample(df: DataFrame, scale: float | DataFrame) -> DataFrame:
    """``df`` at ``scale`` times its size (half-even, at least 1); a table ``image_id, scale`` gives each image its own.

    Weights aren't clamped: at the top and left the two nearest pixels are extrapolated, at the
    bottom and right the last pixel is repeated. Targets whose source lies beyond the image, as
    extreme reductions have, come out NULL."""
    if not isinstance(scale, DataFrame) and scale <= 0:
        raise ValueError("the scale must be positive")
    by = keys(df)
    frames = df.groupBy(*by).agg(F.max("n_rows").alias("_h"), F.max("n_cols").alias("_w"))
    frames = frames.join(scale.select("image_id", F.col("scale").alias("_scale")), "image_id") if isinstance(scale, DataFrame) else frames.withColumn("_scale", F.lit(float(scale)))
    frames = frames.withColumns({"n_rows": scaled(F.col("_h"), F.col("_scale")), "n_cols": scaled(F.col("_w"), F.col("_scale"))})
    out = frames.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).withColumn("col", F.explode(F.sequence(F.lit(1), F.col("n_cols"))))
    corners = []
    for axis, most in (("row", "_h"), ("col", "_w")):
        source = (F.col(axis) - 0.5) / F.col("_scale") + 0.5
        first = F.greatest(F.lit(1), F.floor(source)).cast("int")
        part = source - first
        corners.append([F.struct(first.alias("at"), (1 - part).alias("w")), F.struct(F.least(F.col(most), first + 1).alias("at"), part.alias("w"))])
    four = F.array(*[F.struct(r["at"].alias("r"), c["at"].alias("c"), (r["w"] * c["w"]).alias("w")) for r in corners[0] for c in corners[1]])
    out = out.select(*by, "n_rows", "n_cols", "row", "col", F.explode(four).alias("k")).select(*by, "n_rows", "n_cols", "row", "col", "k.*")
    source = df.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("row").alias("r"), F.col("col").alias("c"), "value")
    joined = out.join(source.withColumnsRenamed({f"_{k}": k for k in by}), [*by, "r", "c"], "left")
    total = F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value")))
    return joined.groupBy(*by, "n_rows", "n_cols", "row", "col").agg(total.alias("value"))
