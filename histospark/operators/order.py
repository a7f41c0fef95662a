"""Ranks and percentiles within groups, without a group in one task.

Rows are ordered by ranges of group and value, so a large group spreads over many partitions.
How many of a group's rows lie before a partition follows from counts by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.runtime import sized, stage


def _ordered(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` by ranges with ``_part``, and ``_g, _p, _n, _before, _all``: a part's rows of a group, those before it and all."""
    ordered = stage(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    of_group = Window.partitionBy("_g")
    return ordered, sized(counts.withColumns({"_before": F.sum("_n").over(of_group.orderBy("_p")) - F.col("_n"), "_all": F.sum("_n").over(of_group)}))


def ranked(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` with the place ``name`` of each row in its group, from 1; ``order`` has no ties in a group, and NULL is a group."""
    ordered, counts = _ordered(df, group, [order])
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order))
    out = ordered.withColumn(name, within).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_before") + F.col(name)).cast("int")).drop("_part", "_g", "_p", "_n", "_before", "_all")


def quantiles(df: DataFrame, group: str, value: Column, tie: list[str], shares: list[float]) -> DataFrame:
    """``group, q``: exact percentiles of each group at ``shares``, interpolated between the closest ranks.

    NULL and NaN aren't counted, nor is a NULL group; ``tie`` are columns that part equal values, so that a frequent
    value doesn't fill one partition. Only partitions with a rank that is wanted are ranked."""
    order = ["_v", *tie]
    rows = df.select(group, value.cast("double").alias("_v"), *tie).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ordered, counts = _ordered(rows, group, order)
    exact = lambda s: (F.col("_all") - 1) * F.lit(float(s))
    ranks = [F.struct(F.lit(2 * i + k).alias("i"), F.least(F.floor(exact(s)) + k, F.col("_all") - 1).alias("rank")) for i, s in enumerate(shares) for k in (0, 1)]
    wanted = counts.select("_g", "_p", "_before", "_n", "_all", F.explode(F.array(*ranks)).alias("w")).where("w.rank >= _before and w.rank < _before + _n")
    wanted = sized(wanted.select("_g", "_p", "_all", F.col("w.i").alias("i"), (F.col("w.rank") - F.col("_before") + 1).cast("int").alias("_k")))
    held = ordered.join(wanted.select(F.col("_g").alias(group), F.col("_p").alias("_part")).distinct(), [group, "_part"], "left_semi")
    placed = held.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_k", "_v")
    found = placed.join(wanted, ["_g", "_p", "_k"]).groupBy("_g").agg(F.first("_all").alias("_all"), *[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(f"_{i}") for i in range(2 * len(shares))])
    between = [F.col(f"_{2 * i}") + (exact(s) - F.floor(exact(s))) * (F.col(f"_{2 * i + 1}") - F.col(f"_{2 * i}")) for i, s in enumerate(shares)]
    return found.select(F.col("_g").alias(group), F.array(*between).alias("q"))
