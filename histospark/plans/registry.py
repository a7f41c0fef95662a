"""The modules whose queries make up the engine's core."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from histospark.plans import image_queries, unit_queries


def modules() -> list[ModuleType]:
    return [image_queries, unit_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of the scene by threshold: histogram, opening, filled holes and components."""
    return image_queries.threshold_mask(spark, sf_dir)
