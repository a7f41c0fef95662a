"""Exact percentiles of groups by a full distributed sort, and summaries that combine.

Rows are range-partitioned and sorted by group, value and a tie-breaking hash, so that
neither a large group nor a frequent value goes to one task. One pass over the sorted
partitions settles every group that lies within a partition, and passes on the sorted
values, in chunks, of the two groups at its ends and of any that is larger than ``WHOLE``, so
that no group is ever held. Their counts per partition give each chunk's offset in its group;
the target positions are located in the chunks and neighbouring order statistics are
interpolated. The number of partitions follows from the number of values. Percentiles are exact: the bound of the
error is 0. Interpolation is linear between closest ranks.

Along with its percentiles each group keeps a summary of at most ``POINTS`` order
statistics at evenly spaced ranks. Summaries of separate days, files or partitions
combine to percentiles of their union; a combined percentile's rank is off by at most
``rank_error`` of the number of values, which is at most ``1 / POINTS``, and 0 where no
part had more values than points.

Defined results: NULL, NaN and infinite values aren't counted, and a group without values
has no row; a NULL group key is a group of its own; ties keep their multiplicity; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histospark.runtime import finite, stage, stage_observed

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
POINTS = 128
CHUNK = 4096
#: Values that a task holds of a group; more go on in chunks.
WHOLE = 16 * CHUNK
#: Values of a partition of the sort.
PARTITION = 2_000_000
_Q = len(QUANTILES)
_KEYS = "level string, metric string, image_id bigint, day date"


def _ranks(n: int) -> np.ndarray:
    """Ranks (from 0) that a group of n values keeps: around each percentile, then the summary's."""
    h = (n - 1) * np.array(QUANTILES)
    low = np.floor(h).astype(np.int64)
    m = min(n, POINTS)
    return np.concatenate([low, np.minimum(low + 1, n - 1), (2 * np.arange(m) + 1) * n // (2 * m)])


def _rank_columns(n: Column) -> Column:
    """The same as an array column."""
    low = [F.floor((n - 1) * q).cast("bigint") for q in QUANTILES]
    m = F.least(n, F.lit(POINTS))
    # integer division: these ranks must be those of _ranks
    rest = F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda j: F.floor(((2 * j + 1) * n - F.pmod((2 * j + 1) * n, 2 * m)) / (2 * m)).cast("bigint"))
    return F.concat(F.array(*low), F.array(*[F.least(x + 1, n - 1) for x in low]), rest)


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: settled groups, and chunks of the first and last group.

    Rows: the group's code columns, n (of the group, or of the chunk), part (-1 if settled),
    start of the chunk in this partition's share of its group, values."""
    names = ["code", "image", "day", "n", "part", "start", "values"]
    first, key, held, sent = True, None, [], 0
    out: list[tuple] = []
    part = -1

    def table() -> pa.RecordBatch:
        code, image, day, n, p, start, values = zip(*out)
        sizes = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        arrays = [pa.array(code, pa.int32()), pa.array(image, pa.int64()), pa.array(day, pa.int32()), pa.array(n, pa.int64()), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(values), pa.float64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    def chunks(values: np.ndarray, start: int) -> None:
        for i in range(0, len(values), CHUNK):
            out.append((*key, len(values[i : i + CHUNK]), part, start + i, values[i : i + CHUNK]))

    for batch in batches:
        if not batch.num_rows:
            continue
        code, image, day, values, parts = (np.asarray(batch.column(i)) for i in range(5))
        part = int(parts[0])
        new = np.flatnonzero((code[1:] != code[:-1]) | (image[1:] != image[:-1]) | (day[1:] != day[:-1])) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            this = (int(code[a]), int(image[a]), int(day[a]))
            if key is not None and this != key:
                whole = np.concatenate(held) if held else np.empty(0)
                if first or sent:
                    chunks(whole, sent)
                    first = False
                else:
                    n = len(whole)
                    out.append((*key, n, -1, 0, whole[_ranks(n)]))
                held, sent = [], 0
            key = this
            held.append(values[a:b])
            if sum(map(len, held)) >= WHOLE:
                whole = np.concatenate(held)
                chunks(whole, sent)
                held, sent = [], sent + len(whole)
            if len(out) > 2000:
                yield table()
    if key is not None and held:
        chunks(np.concatenate(held), sent)
    if out:
        yield table()


def percentiles(values: DataFrame, metrics: list[str]) -> DataFrame:
    """Groups of ``values`` (``image_id, day, tie`` and the columns ``metrics``) on three levels.

    Result: ``level`` (image_day, image or day), ``metric, image_id, day, n``, one column for
    each of QUANTILES, ``rank_error`` (0) and ``summary``, the ordered points that combine."""
    values, seen = stage_observed(values, n=F.count("*"))  # range partitioning reads it twice
    levels = [("image_day", True, True), ("image", True, False), ("day", False, True)]
    none_i, none_d = F.lit(-(2**63)).cast("bigint"), F.lit(-(2**31)).cast("int")
    absent_i, absent_d = F.lit(-(2**63) + 1).cast("bigint"), F.lit(-(2**31) + 1).cast("int")
    image, day = F.coalesce("image_id", absent_i), F.coalesce(F.unix_date("day"), absent_d)
    rows = [F.struct(F.lit(i * len(metrics) + k).alias("code"), (image if by_image else none_i).alias("image"), (day if by_day else none_d).alias("day"), finite(F.col(m).cast("double")).alias("value")) for i, (_, by_image, by_day) in enumerate(levels) for k, m in enumerate(metrics)]
    long = values.select(F.explode(F.array(*rows)).alias("r"), "tie").select("r.*", "tie").where("value is not null")
    parts = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] * len(rows) // PARTITION))
    order = ["code", "image", "day", "value", "tie"]
    ordered = long.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("code", "image", "day", "value", F.spark_partition_id().alias("part"))
    passed = stage(ordered.mapInArrow(_pass, "code int, image bigint, day int, n bigint, part int, start bigint, values array<double>"))

    group = ["code", "image", "day"]
    done = passed.where("part < 0").select(*group, "n", F.col("values").alias("points"))
    cut = passed.where("part >= 0")
    # no more rows than two for each partition and the partitions that a group spans
    offsets = cut.groupBy(*group, "part").agg(F.sum("n").alias("_n"))
    by_part = Window.partitionBy(*group)
    offsets = offsets.select(*group, "part", (F.sum("_n").over(by_part.orderBy("part")) - F.col("_n")).alias("offset"), F.sum("_n").over(by_part).alias("total"))
    located = cut.join(offsets, [*group, "part"]).withColumns({"at": F.col("offset") + F.col("start"), "ranks": _rank_columns(F.col("total"))})
    wanted = F.filter(F.transform("ranks", lambda r, i: F.struct(i.alias("i"), (r - F.col("at")).cast("int").alias("k"))), lambda s: (s["k"] >= 0) & (s["k"] < F.size("values")))
    points = located.select(*group, "total", F.explode(F.transform(wanted, lambda s: F.struct(s["i"].alias("i"), F.get("values", s["k"]).alias("v")))).alias("p"))
    # at most 2 * len(QUANTILES) + POINTS points for a group
    joined = points.groupBy(*group, F.col("total").alias("n")).agg(F.transform(F.sort_array(F.collect_list("p")), lambda s: s["v"]).alias("points"))

    every = done.unionByName(joined)
    between = []
    for i, q in enumerate(QUANTILES):
        h = (F.col("n") - 1) * q
        low, high = F.get("points", F.lit(i)), F.get("points", F.lit(_Q + i))
        between.append((low + (h - F.floor(h)) * (high - low)).alias(name(q)))
    label = lambda items, k: F.element_at(F.array(*[F.lit(x) for x in items]), (k + 1).cast("int"))
    return every.select(
        label([x for x, _, _ in levels], F.floor(F.col("code") / len(metrics))).alias("level"),
        label(metrics, F.pmod("code", F.lit(len(metrics)))).alias("metric"),
        F.when(~F.col("image").isin(-(2**63), -(2**63) + 1), F.col("image")).alias("image_id"),
        F.when(~F.col("day").isin(-(2**31), -(2**31) + 1), F.date_from_unix_date("day")).alias("day"),
        "n",
        *between,
        F.lit(0.0).alias("rank_error"),
        F.slice("points", F.lit(2 * _Q + 1), F.greatest(F.size("points") - 2 * _Q, F.lit(0))).alias("summary"),
    )


def name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def combine(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Percentiles of unions of groups from their summaries: ``keys, n, p01 .. p99, rank_error``.

    ``parts`` are rows of ``percentiles`` (of any days, files or runs) with ``n`` and ``summary``."""
    weight = F.col("n") / F.size("summary")
    # a kept point stands for weight values, half of them below it
    error = F.when(F.col("n") > F.size("summary"), weight).otherwise(0.0)
    points = parts.select(*keys, F.explode("summary").alias("v"), weight.alias("w"))
    totals = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.try_divide(F.sum(error), F.sum("n")).alias("rank_error"))
    points = points.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("upto", F.sum("w").over(up))
    total = F.sum("w").over(Window.partitionBy(*keys))
    points = points.withColumn("total", total)
    least = [F.min(F.when(F.col("upto") >= F.greatest(F.col("total") * q, F.lit(1e-9)) - 1e-6, F.col("v"))).alias(name(q)) for q in QUANTILES]
    found = points.groupBy(*keys).agg(*least)
    left = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "rank_error")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = on[0]
    for x in on[1:]:
        both = both & x
    return found.join(left, both).select(*keys, "n", *[name(q) for q in QUANTILES], "rank_error")


def measurements(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each measurement of a cell: ``image_id, day, tie`` and ``columns``.

    Copies of a row, also those loaded again later, count once; another tool's export of the
    same cell is a measurement of its own."""
    rows = features.select("image_id", "cell_id", "tool", "extracted_at", *columns).distinct()
    return rows.select("image_id", F.to_date("extracted_at").alias("day"), F.xxhash64("image_id", "cell_id", "tool", "extracted_at").alias("tie"), *columns)
