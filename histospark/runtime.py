"""Session helpers: reading tables and cutting lineage where executors may be lost."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode also a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="histospark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, its lineage cut.

    Unlike a local checkpoint it survives the loss of executors, and unlike a
    reliable RDD checkpoint it is columnar and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stage`` with aggregates of the rows, taken while they are written: no job of its own."""
    seen = Observation()
    out = stage(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
    return out, seen.get


def sized(df: DataFrame) -> DataFrame:
    """``stage``, for a table of aggregates that a far larger one is joined with.

    The planner takes an aggregate for as large as its input and would exchange both sides;
    of a written table it knows the size, and broadcasts it if that is below its threshold."""
    return stage(df)


_paths: list[tuple[SparkSession, str]] = []


def drop_staged(first: int = 0) -> None:
    """Delete the tables written by ``stage``, but the first so many; results that read them can't be computed any more."""
    while len(_paths) > first:
        spark, path = _paths.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the cluster's own cleaning has to do
            return


@contextmanager
def staging() -> Iterator[None]:
    """Tables written inside are deleted at the end, so that a long session doesn't fill the shared folder."""
    first = len(_paths)
    try:
        yield
    finally:
        drop_staged(first)


atexit.register(drop_staged)


def finite(c: Column) -> Column:
    """``c``, with NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def same_size(a: str, b: str, value: Column) -> Column:
    """``value``, an error where the sizes of ``a`` and ``b`` (columns ``{a}_rows, {a}_cols``) differ."""
    differ = (F.col(f"{a}_rows") != F.col(f"{b}_rows")) | (F.col(f"{a}_cols") != F.col(f"{b}_cols"))
    return F.when(differ, F.raise_error(F.lit("images and masks must be of the same size"))).otherwise(value)


def over(a: Column, b: Column | float) -> Column:
    """``a / b``, NULL where ``b`` is 0: guards of ``when`` don't hold for expressions that are computed once."""
    return a / F.nullif(b if isinstance(b, Column) else F.lit(b), F.lit(0).cast("double"))
