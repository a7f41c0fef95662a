"""Choosing a varied subset: fixed-size samples with probability inverse to local density.

A record's density is the mean, over REPEATS locality-sensitive hashes, of the number of
records in its bucket. Buckets are counted exactly, by repeat and 64-bit hash: near records
are brought into chunks of at most ``1 << CHUNK_BITS``, each chunk counts its own buckets,
the counts are added up over all chunks and come back to the chunks that have the bucket.
So no table of all buckets is ever in one place. A second pass, one for all requests, draws
weighted samples without replacement: the records with the least ``-ln(u) / weight``, u being
a hash of record and request and the weight one over the density.

Defined results: a population of no more records than asked for is taken whole; repeated
rows are one record; a NULL, NaN or infinite coordinate is a place of its own; equal
records share a bucket, so together they weigh about as much as one; an unknown
population gives no rows; a request that is repeated counts once, with its greatest size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm.splits import task_images
from histospark.runtime import finite, stage

REPEATS = 32
#: Logarithm of the most records of a chunk; a chunk has at most REPEATS times as many buckets.
CHUNK_BITS = 16
#: Side of a bucket in units of the coordinates, which are scaled to about 1 where records are near.
SIDE = 1.0
#: Requests that may be answered at once, since their table is collected.
MAX_REQUESTS = 1000
#: Bins of the keys below a request's threshold.
BINS = 65_536
_KEYS = ["image_id", "cell_id", "task_id", "patch_id"]


def cell_records(features: DataFrame) -> DataFrame:
    """One record per cell, at its size and row: ``features`` must have ``area_px, centroid_row_px``.

    Sizes are near within a factor of about 1.4, rows within 64 pixels."""
    area = F.col("area_px")
    rows = features.where("image_id is not null and cell_id is not null").groupBy("image_id", "cell_id").agg(F.avg(F.when(area > 0, F.log2(area))).alias("a"), F.avg("centroid_row_px").alias("r"))
    nothing = F.lit(None).cast("bigint")
    return rows.select("image_id", F.col("cell_id").cast("int"), nothing.alias("task_id"), F.lit(None).cast("int").alias("patch_id"), F.lit(0).cast("bigint").alias("place"), (F.col("a") * 2).alias("x0"), (F.col("r") / 64).alias("x1"), F.lit(0.0).alias("x2"))


def patch_records(patches: DataFrame, tasks: DataFrame) -> DataFrame:
    """One record per patch of a task, at its place in the image and its size.

    A patch whose image isn't named belongs to its task's only image, else to the task itself.
    Places are near within half a patch side, sizes within a factor of about 1.4."""
    images = task_images(tasks).where("image_id is not null").groupBy("task_id").agg(F.min("image_id").alias("_lo"), F.max("image_id").alias("_hi")).where("_lo = _hi").select(F.col("task_id").alias("_t"), F.col("_lo").alias("_only"))
    window = ["row_start", "row_end", "col_start", "col_end"]
    rows = patches.select("task_id", "image_id", "patch_id", *window).distinct().join(images, F.col("task_id") == F.col("_t"), "left")
    rows = rows.withColumn("image_id", F.coalesce("image_id", "_only")).groupBy("task_id", "image_id", "patch_id").agg(*[F.min(c).alias(c) for c in window])
    side = F.sqrt((F.col("row_end") - F.col("row_start") + 1.0) * (F.col("col_end") - F.col("col_start") + 1.0))
    step = F.greatest(side / 2, F.lit(1.0))
    middle = lambda a: (F.col(f"{a}_start") + F.col(f"{a}_end")) / 2 / step
    return rows.select("image_id", F.lit(None).cast("int").alias("cell_id"), "task_id", F.col("patch_id").cast("int"), F.coalesce("image_id", -F.col("task_id") - 1, F.lit(0)).alias("place"), middle("row").alias("x0"), middle("col").alias("x1"), (F.log2(side) * 2).alias("x2"))


def _buckets(place: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of each record, for each repeat; the same on every machine."""
    rng = np.random.default_rng(20)
    absent = np.isnan(x)
    x = np.where(absent, 0.0, x)
    mark = (absent * (1 << np.arange(x.shape[1]))).sum(axis=1).astype(np.uint64)
    for _ in range(REPEATS):
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        cells = np.floor((x @ turn) / SIDE + rng.uniform(size=x.shape[1])).astype(np.int64).astype(np.uint64)
        h = place.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mark
        for i in range(x.shape[1]):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cells[:, i]
        yield ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).astype(np.int64)


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["place"].to_numpy(), np.column_stack([rows[f"x{i}"].to_numpy().astype(float) for i in range(3)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows of one chunk; a chunk that is read in parts gives several."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("chunk")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and ids[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = int(ids[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def densities(records: DataFrame) -> DataFrame:
    """``records`` (keys, ``place, x0, x1, x2``) with ``density``, 1 or more."""
    place = ["place", "x0", "x1", "x2"]
    records = records.withColumns({f"x{i}": finite(F.col(f"x{i}")) for i in range(3)})
    # near records share buckets, so that chunks of them have few; the keys part crowds of equal records
    records = stage(records.select(*_KEYS, *place).repartitionByRange(*place, *_KEYS).withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _chunks(batches):
            for r, b in enumerate(_buckets(*_columns(rows))):
                bucket, n = np.unique(b, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(np.full(len(n), r, np.int32)), pa.array(bucket), pa.array(n)], ["chunk", "repeat", "bucket", "n"])

    counts = records.select("chunk", *place).mapInArrow(count, "chunk bigint, repeat int, bucket bigint, n bigint")
    # a bucket has about one row for each chunk, however many records are in it
    counts = counts.withColumn("n", F.sum("n").over(Window.partitionBy("repeat", "bucket")))

    def look(rows: pa.Table, counted: pa.Table) -> pa.Table:
        density = np.zeros(rows.num_rows)
        repeat, bucket, n = (counted[c].to_numpy() for c in ("repeat", "bucket", "n"))
        order = np.lexsort((bucket, repeat))
        bucket, n, starts = bucket[order], n[order], np.searchsorted(repeat[order], np.arange(REPEATS + 1))
        if rows.num_rows:
            for r, b in enumerate(_buckets(*_columns(rows))):
                own = slice(starts[r], starts[r + 1])
                density += n[own][np.searchsorted(bucket[own], b)]
        return rows.select(_KEYS).append_column("density", pa.array(density / REPEATS))

    schema = records.select(*_KEYS).schema.add("density", "double")
    return records.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(look, schema)


def _threshold(bands: list, size: int) -> float:
    """A key below which about ``size`` records' keys lie, and very probably no fewer; infinite if there aren't more records."""
    n = np.array([b.n for b in bands], float)
    if n.sum() <= size:
        return float("inf")
    density = np.array([b.density for b in bands])
    wanted = min(size + 6 * size**0.5 + 12, n.sum() - 0.5)
    low, high = 0.0, float(density.max())
    while (n * -np.expm1(-high / density)).sum() < wanted:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * -np.expm1(-middle / density)).sum() < wanted else (low, middle)
    return high


def choose(dense: DataFrame, sizes: dict[int, int], seed: int = 1) -> DataFrame:
    """``request_id, _KEYS, density``: for each request its ``size`` records of ``dense``, drawn in inverse proportion to the density.

    All requests are answered in one pass over ``dense``: a record's key for a request has the
    exponential distribution of its weight, so a few sums tell about how many keys lie below a
    threshold. Records below it are written, as many as are asked for and a few more; of those
    the least are taken by counts of the bins of their keys, and only the bin in which the size
    is reached is ranked."""
    bands = dense.groupBy(F.floor(F.log2("density") * 8).alias("band")).agg(F.count("*").alias("n"), F.avg("density").alias("density")).collect()  # eight for each doubling
    limits = {r: _threshold(bands, n) for r, n in sizes.items()}
    u = lambda r: (F.pmod(F.xxhash64(F.lit(seed), r, *[F.coalesce(F.col(k).cast("bigint"), F.lit(-1)) for k in _KEYS]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    while True:
        asked = F.array(*[F.struct(F.lit(r).cast("bigint").alias("id"), F.lit(n).cast("bigint").alias("size"), F.lit(limits[r]).alias("limit")) for r, n in sizes.items()])
        drawn = F.filter(F.transform(asked, lambda q: F.struct(q["id"].alias("request_id"), q["size"].alias("size"), q["limit"].alias("limit"), (-F.log(u(q["id"])) * F.col("density")).alias("key"))), lambda d: d["key"] <= d["limit"])
        near = stage(dense.select(*_KEYS, "density", F.explode(drawn).alias("d")).select(*_KEYS, "density", "d.*"))
        found = {r.request_id: r["count"] for r in near.groupBy("request_id").count().collect()}  # MAX_REQUESTS rows
        short = [r for r, n in sizes.items() if limits[r] < float("inf") and found.get(r, 0) < n]
        if not short:
            break
        limits |= {r: limits[r] * 2 for r in short}
    near = near.withColumn("bin", F.when(F.col("limit") < float("inf"), F.floor(F.col("key") / F.col("limit") * BINS)).otherwise(0))
    up = Window.partitionBy("request_id").orderBy("bin")
    bins = near.groupBy("request_id", "bin").agg(F.count("*").alias("n")).select(F.col("request_id").alias("_r"), F.col("bin").alias("_b"), "n", (F.sum("n").over(up) - F.col("n")).alias("before"))
    near = near.join(bins, (F.col("request_id") == F.col("_r")) & (F.col("bin") == F.col("_b"))).where("before < size")
    columns = ["request_id", *_KEYS, "density"]
    last = near.where("before + n > size").withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("key", *_KEYS))).where("before + rank <= size")
    return near.where("before + n <= size").select(*columns).unionByName(last.select(*columns))


def _asked(requests: DataFrame, populations: dict[str, DataFrame]) -> dict[str, dict[int, int]]:
    rows = requests.where("request_id is not null and subset_size > 0").groupBy("request_id", "population").agg(F.max("subset_size").alias("size")).orderBy("request_id", "population").limit(MAX_REQUESTS + 1).collect()
    if len(rows) > MAX_REQUESTS:
        raise ValueError(f"more than {MAX_REQUESTS} requests")
    out: dict[str, dict[int, int]] = {}
    for r in rows:
        if r.population in populations:
            out.setdefault(r.population, {})[r.request_id] = r["size"]
    return out


_SUBSET = "request_id bigint, population string, image_id bigint, cell_id int, task_id bigint, patch_id int, density double"
_COVERAGE = "request_id bigint, population string, crowd bigint, n_population bigint, n_chosen bigint"


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def subsets(requests: DataFrame, populations: dict[str, DataFrame]) -> DataFrame:
    """``request_id, population, image_id, cell_id, task_id, patch_id, density`` of all chosen records."""
    parts = [choose(stage(densities(populations[p])), sizes).withColumn("population", F.lit(p)) for p, sizes in _asked(requests, populations).items()]
    return _union(requests.sparkSession, parts, _SUBSET)


def coverage(requests: DataFrame, populations: dict[str, DataFrame]) -> DataFrame:
    """Per request and ``crowd``, a density's power of two rounded down, the records there are and those chosen."""
    parts = []
    crowd = F.expr("shiftleft(1L, int(floor(log2(density))))").alias("crowd")
    for p, sizes in _asked(requests, populations).items():
        dense = stage(densities(populations[p]))
        every = dense.groupBy(crowd).agg(F.count("*").alias("n_population"), F.lit(0).cast("bigint").alias("n_chosen"))
        every = every.withColumn("request_id", F.explode(F.array(*[F.lit(r).cast("bigint") for r in sizes])))
        chosen = choose(dense, sizes).groupBy("request_id", crowd).agg(F.lit(0).cast("bigint").alias("n_population"), F.count("*").alias("n_chosen"))
        both = every.unionByName(chosen).groupBy("request_id", "crowd").agg(F.sum("n_population").alias("n_population"), F.sum("n_chosen").alias("n_chosen"))
        parts.append(both.withColumn("population", F.lit(p)))
    return _union(requests.sparkSession, parts, _COVERAGE)
