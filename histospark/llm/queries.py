"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm import bpe, clusters, mix, percentiles, spam, splits, subset
from histospark.operators import units
from histospark.plans.unit_queries import values_sql
from histospark.runtime import load, stage


def _pixels(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``features`` with areas and centroid rows in pixels, units being settled as in p2."""
    features, masks, images = (load(spark, sf_dir, t) for t in ("features", "masks", "images"))
    runs = stage(units.settle(features, masks, images).runs)
    return units.convert_features(features.select("image_id", "tool", "area", "centroid_row", *columns), runs)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(clusters.shapes(_pixels(spark, sf_dir, "cell_id", "circularity", "eccentricity", "solidity")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return clusters.same_group(load(spark, sf_dir, "cell_pairs"), cells, clusters.find_groups(cells))


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's group."""
    cells = _cells(spark, sf_dir)
    return clusters.assign(cells, clusters.find_groups(cells)).select("image_id", "cell_id", "group_id", "distance")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's size and most typical cells."""
    cells = _cells(spark, sf_dir)
    return clusters.describe(clusters.assign(cells, clusters.find_groups(cells)))


def p3_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf's group, size, spread and centre-nearest cells."""
    cells = _cells(spark, sf_dir)
    return clusters.describe(clusters.assign_leaves(cells, clusters.find_groups(cells)), "leaf_id")


def _related(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, sf_dir, "images"), load(spark, sf_dir, "masks"), load(spark, sf_dir, "annotation_tasks")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.families(splits.spanning_forest(splits.relations(*_related(spark, sf_dir))))


def p5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the spanning forest; nodes below 0 are patients and tasks."""
    return splits.spanning_forest(splits.relations(*_related(spark, sf_dir))).edges


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every mask and annotation task."""
    return splits.assign(*_related(spark, sf_dir), load(spark, sf_dir, "split_targets"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.list_pages(load(spark, sf_dir, "documents"))


def p8_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's redundancy, punctuation and share of list words."""
    return spam.judge(load(spark, sf_dir, "documents"))


def _populations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    populations = {
        "features": subset.cell_records(_pixels(spark, sf_dir, "cell_id")),
        "patches": subset.patch_records(load(spark, sf_dir, "patches"), load(spark, sf_dir, "annotation_tasks")),
    }
    return load(spark, sf_dir, "subset_requests"), populations


def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records chosen for every row of ``subset_requests``."""
    return subset.subsets(*_populations(spark, sf_dir))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each density there are, and how many of them are chosen."""
    return subset.coverage(*_populations(spark, sf_dir))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir, "cell_id", "perimeter", "extracted_at")
    measured = percentiles.measurements(rows.withColumn("area", rows["area_px"]), ["area", "perimeter"])
    return percentiles.percentiles(measured, ["area", "perimeter"])


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per image and day, per image, and per day."""
    return _measured(spark, sf_dir).drop("summary")


def p4_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of whole images, combined from the summaries of their days."""
    days = stage(_measured(spark, sf_dir).where("level = 'image_day'").select("metric", "image_id", "n", "summary"))
    return percentiles.combine(days, ["metric", "image_id"])


def _outer(rows: DataFrame, metric: str, places: int) -> DataFrame:
    out = percentiles.percentiles(percentiles.measurements(rows, [metric]), [metric])
    return out.select("level", "image_id", "day", "n", *[F.round(c, places).alias(c) for c in _OUTER])


def p4_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians, quartiles and outer percentiles of the perimeters of each image, day, and day of an image."""
    return _outer(load(spark, sf_dir, "features"), "perimeter", 9)


def p4_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of areas in pixels."""
    rows = _pixels(spark, sf_dir, "cell_id", "extracted_at")
    return _outer(rows.withColumn("area", rows["area_px"]), "area", 6)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mix.Source], int]:
    asked = mix.asked(load(spark, sf_dir, "mix_targets"))
    pieces = mix.packed(load(spark, sf_dir, "documents"), [name for name, _, _ in asked])
    return pieces, *mix.plan(pieces, asked)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the mixture with its token ids and the spans of documents that they are of."""
    return mix.mixture(*_packed(spark, sf_dir)[:2])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares and repeats of every source."""
    return mix.report(spark, *_packed(spark, sf_dir)[1:])


QUERIES = {
    f.__name__: f
    for f in (p1_subset, p1_coverage, p3_found, p3_cells, p3_groups, p3_leaves, p4_percentiles, p4_combined, p4_perimeter, p4_area, p5_found, p5_forest, p5_splits, p6_ids, p7_mix, p7_shares, p8_found, p8_judged)
}
_DIGITS = "translate(e.value, '０１２３４５６７８９', '0123456789')"
_REF = "try_cast(nullif(regexp_extract({}, '([0-9]+)', 1), '') AS BIGINT)".format
_HEADER = r'"(?:origin|parent|derived_from|source)"\s*:\s*([^,}]*)'
_OUTER = ("p05", "p25", "p50", "p75", "p95")


def _levels(places: int) -> str:
    """Percentiles of ``there`` (``image_id, day, x``) on three levels."""
    return f"""levels AS (SELECT 'image_day' AS level, image_id, day, x FROM there UNION ALL SELECT 'image', image_id, NULL, x FROM there UNION ALL SELECT 'day', NULL, day, x FROM there)
        SELECT level, image_id, day, count(*) AS n, {", ".join(f"round(quantile_cont(x, 0.{c[1:]}), {places}) AS {c}" for c in _OUTER)}
        FROM levels GROUP BY level, image_id, day"""


SQL = {
    "p5_found": rf"""
        WITH RECURSIVE entries AS (SELECT image_id, site, unnest(map_entries(metadata)) AS e FROM images),
        facts AS (SELECT image_id, site, lower(e.key) AS k, {_DIGITS} AS v FROM entries),
        patients AS (SELECT image_id, site, try_cast(regexp_extract(v, '([0-9]+)', 1) AS BIGINT) AS number FROM facts
          WHERE regexp_matches(k, '^(?:patient|pat[-_ .]?(?:nr|no|id)|subject)') AND site IS NOT NULL AND regexp_full_match(v, '[^0-9]*[0-9]+[^0-9]*')),
        same AS (SELECT min(image_id) OVER (PARTITION BY site, number) AS a, image_id AS b FROM patients WHERE number <> 0),
        refs AS (
          SELECT {_REF("v")} AS a, image_id AS b FROM facts WHERE regexp_matches(k, '(?:_of|parent|derived|from|origin|source)(?:_?image|_?id)?(?:_[0-9]+)?$')
          UNION ALL SELECT {_REF(f"regexp_extract(v, '{_HEADER}', 1)")}, image_id FROM facts WHERE regexp_matches(v, '{_HEADER}')
          UNION ALL SELECT try_cast(unnest(regexp_extract_all(lower(v), '(?:{splits.MADE_FROM})[^0-9;]*([0-9]+)', 1)) AS BIGINT), image_id FROM facts
          UNION ALL SELECT {_REF(_DIGITS)}, image_id FROM (SELECT image_id, unnest(map_entries(model_info)) AS e FROM masks WHERE model_info IS NOT NULL) WHERE regexp_matches(lower(e.key), 'regist|align')),
        covered AS (SELECT task_id, coalesce(image_id, {_REF("translate(image_ref, '０１２３４５６７８９', '0123456789')")}) AS image_id FROM annotation_tasks WHERE task_id IS NOT NULL),
        tasks AS (SELECT min(image_id) OVER (PARTITION BY task_id) AS a, image_id AS b FROM covered SEMI JOIN images USING (image_id)),
        pairs AS (SELECT * FROM same UNION ALL SELECT * FROM refs UNION ALL SELECT * FROM tasks),
        known AS (SELECT p.a, p.b FROM pairs p WHERE a <> b AND a IN (SELECT image_id FROM images) AND b IN (SELECT image_id FROM images)),
        edges AS MATERIALIZED (SELECT a, b FROM known UNION SELECT b, a FROM known),
        reach AS (SELECT DISTINCT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b)
        SELECT min(root) AS root_id, node AS image_id FROM reach GROUP BY node HAVING min(root) < node""",
    "p4_perimeter": f"""WITH there AS (SELECT DISTINCT image_id, cell_id, tool, extracted_at, CAST(extracted_at AS DATE) AS day, perimeter AS x FROM features WHERE perimeter IS NOT NULL AND NOT isnan(perimeter)), {_levels(9)}""",
    "p4_area": f"""WITH {values_sql()}, there AS (SELECT DISTINCT image_id, cell_id, tool, extracted_at, CAST(extracted_at AS DATE) AS day, area_px AS x FROM converted WHERE area_px IS NOT NULL), {_levels(6)}""",
}
