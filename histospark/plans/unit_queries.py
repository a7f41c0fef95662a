"""Queries of problem 2: quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.functions import unittext as U
from histospark.operators import units
from histospark.runtime import load


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, sf_dir, "features"), load(spark, sf_dir, "masks"), load(spark, sf_dir, "images")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, masks, images = _tables(spark, sf_dir)
    return units.other_units(features, units.settle(features, masks, images))


def p2_pixel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's pixel size in µm per pixel, with the way its unit was settled."""
    return units.settle(*_tables(spark, sf_dir)).sizes


def p2_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's area and centroid row in pixels, beside the recorded values, and how sure their units are."""
    features, masks, images = _tables(spark, sf_dir)
    rows = units.convert_features(features, units.settle(features, masks, images).runs)
    sure = [f"unit_{k}_{c}" for k in ("area", "row") for c in ("status", "probability")]
    return rows.select("image_id", "cell_id", "tool", "area", "unit_area", "area_px", "centroid_row", "unit_row", "centroid_row_px", *sure)


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's pixel size and its unit, without the way it was settled."""
    sizes = units.settle(*_tables(spark, sf_dir)).sizes
    return sizes.select("image_id", "unit", F.round("x_um", 6).alias("x_um"), F.round("y_um", 6).alias("y_um"))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's values in pixels, without the way their units were settled."""
    features, masks, images = _tables(spark, sf_dir)
    rows = units.convert_features(features, units.settle(features, masks, images).runs)
    return rows.select("image_id", "cell_id", "tool", F.col("unit_area").alias("area_unit"), F.round("area_px", 4).alias("area_px"), F.col("unit_row").alias("row_unit"), F.round("centroid_row_px", 4).alias("row_px"))


def p2_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs and images whose unit neither the forest nor the check settles."""
    return units.to_review(units.settle(*_tables(spark, sf_dir)))


def p2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and calibration of the forests on held-out statements."""
    return units.accuracy(spark, units.settle(*_tables(spark, sf_dir)).forests)


QUERIES = {f.__name__: f for f in (p2_found, p2_pixel_sizes, p2_sizes, p2_converted, p2_values, p2_review, p2_accuracy)}


def _case(text: str, table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{name}'" for name, p in table.items()) + " END"


def _plain(c: str) -> str:
    return f"translate(lower({c}), '０１２３４５６７８９µμ²', '0123456789uu2')"


def _stated(source: str, out: str) -> str:
    """Units that the text ``said`` of each row of ``source`` states for areas and rows; NULL where it states none."""
    rest = "said"
    for p in U.AREAS.values():
        rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"
    pos = _case("rest", U.POSITIONS)
    return f"""{out}_rest AS (SELECT *, {_case("said", U.AREAS)} AS a, {rest} AS rest FROM {source}), {out}_both AS (SELECT *, {pos} AS p FROM {out}_rest),
{out} AS (SELECT image_id, tool, coalesce(a, 'px') AS area_unit, coalesce(p, 'px') AS row_unit FROM {out}_both WHERE a IS NOT NULL OR p IS NOT NULL OR regexp_matches(said, '{U.PIXELS}'))"""


def _ranked_max(c: str, units_: list[str]) -> str:
    return f"arg_max({c}, list_position({units_!r}, {c}))"


def values_sql() -> str:
    """Common tables of units and values by statements and plain rules alone, for checks: ``sizes, runs, converted``."""
    lengths = {k: p for k, (p, _) in U.LENGTHS.items()}
    real = lambda c: f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} END"
    first = lambda p, k: f"nullif(regexp_extract(said, '{p}', {k}), '')"
    number = f"coalesce({first(units.WRITTEN, 1)}, {first(units.DENSITY, 1)})"
    named = f"coalesce({first(units.WRITTEN, 2)}, {first(units.DENSITY, 2)})"
    of_key = f"coalesce({_case(f"regexp_extract(said, '{units.UNIT_KEY}', 1)", lengths)}, {_case(f"regexp_extract(said, '{units.UNIT_NOTE}', 1)", lengths)})"
    micro = lambda v, unit: "CASE " + unit + " " + " ".join(f"WHEN '{k}' THEN {f'{f} / {v}' if k in U.DENSITIES else f'{v} * {f}'}" for k, (_, f) in U.LENGTHS.items()) + " END"
    low, high = units.PLAUSIBLE
    likely = "CASE " + " ".join(f"WHEN {f'{U.LENGTHS[k][1]} / v' if k in U.DENSITIES else f'v * {U.LENGTHS[k][1]}'} BETWEEN {low} AND {high} THEN '{k}'" for k in units.LENGTH_UNITS) + " END"
    metric = lambda k: f"CASE WHEN x_um * y_um IS NOT NULL THEN abs(ratio / (x_um * y_um * {k}) - 1) < 0.02 ELSE ratio / {k} BETWEEN {low**2} AND {high**2} END"
    by_ratio = f"CASE WHEN abs(ratio - 1) < 0.002 THEN 'px' WHEN abs(ratio / 1e-3 - 1) < 0.03 THEN 'kpx' WHEN {metric(1.0)} THEN 'um2' WHEN {metric(1e-6)} THEN 'mm2' WHEN {metric(1e6)} THEN 'nm2' ELSE 'px' END"
    tall = lambda k: f"top <= (n_rows + 1) * coalesce(y_um, {high}) * {k} AND fine > 0.1"
    by_rows = f"CASE WHEN coalesce(top <= n_rows + 1, true) AND NOT coalesce(fine > 0.1, false) THEN 'px' WHEN {tall(1.0)} THEN 'um' WHEN {tall(1e-3)} THEN 'mm' WHEN top <= (n_rows + 1) * coalesce(y_um, {high}) * 1e3 AND top > n_rows + 1 THEN 'nm' WHEN top <= 100.001 AND fine > 0.1 THEN 'percent' WHEN top <= 1.00001 AND fine > 0.1 THEN 'fraction' ELSE 'px' END"
    metric_factor = lambda k: f"coalesce(1 / (x_um * y_um * {k}), 1 / ratio)"
    return f"""texts AS (SELECT image_id, {real("resolution.x_um")} AS x, {real("resolution.y_um")} AS y,
    coalesce((SELECT string_agg({_plain("e.key")} || '=' || coalesce({_plain("e.value")}, ''), ' ; ') FROM (SELECT unnest(map_entries(metadata)) AS e)), '') AS said FROM images),
read AS (SELECT image_id, CASE WHEN x > 0 THEN x END AS x, CASE WHEN y > 0 THEN y END AS y, try_cast(replace({number}, ',', '.') AS DOUBLE) AS own, {named} AS own_unit, {of_key} AS key_unit FROM texts),
given AS (SELECT image_id, coalesce(x, y, CASE WHEN own > 0 THEN own END) AS v, coalesce(y, x, CASE WHEN own > 0 THEN own END) AS tall, CASE WHEN x IS NULL AND y IS NULL THEN coalesce({_case("own_unit", lengths)}, key_unit) ELSE key_unit END AS stated FROM read),
sizes AS MATERIALIZED (SELECT *, {micro("v", "unit")} AS x_um, {micro("tall", "unit")} AS y_um FROM (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce(stated, {likely}) END AS unit FROM given)),
notes AS (SELECT DISTINCT image_id, tool, {_plain("unit_note")} AS said FROM features WHERE unit_note IS NOT NULL), {_stated("notes", "noted")},
infos AS (SELECT DISTINCT image_id, element_at(model_info, 'tool')[1] AS tool, {_plain("(SELECT string_agg(e.value, ' | ') FROM (SELECT unnest(map_entries(model_info)) AS e) WHERE e.key NOT IN ('tool', 'method') AND NOT regexp_matches(e.key, 'regist|align|target|tile'))")} AS said
  FROM masks WHERE model_info IS NOT NULL AND image_id IS NOT NULL), {_stated("infos", "made")},
says AS (SELECT image_id, tool, {_ranked_max("area_unit", units.AREA_UNITS)} AS area, {_ranked_max("row_unit", units.ROW_UNITS)} AS row_ FROM noted GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT image_id, tool, {_ranked_max("area_unit", units.AREA_UNITS)}, {_ranked_max("row_unit", units.ROW_UNITS)} FROM made GROUP BY ALL) m WHERE NOT EXISTS (SELECT 1 FROM noted WHERE noted.image_id IS NOT DISTINCT FROM m.image_id AND noted.tool IS NOT DISTINCT FROM m.tool)),
cells AS (SELECT image_id, cell_id, tool, extracted_at, {real("area")} AS area, {real("circularity * perimeter * perimeter / (4 * pi())")} AS pixels, {real("centroid_row")} AS row_ FROM features),
seen AS (SELECT image_id, tool, sum(area) FILTER (area > 0 AND pixels > 0) / sum(pixels) FILTER (area > 0 AND pixels > 0) AS ratio, max(row_) AS top,
  avg(CAST(abs(row_ * 100 - round(row_ * 100)) > 1e-4 * greatest(1.0, abs(row_) * 1e-6) AS DOUBLE)) AS fine FROM cells GROUP BY ALL),
known AS (SELECT r.*, s.area AS area_said, s.row_ AS row_said, i.n_rows, z.x_um, z.y_um FROM seen r LEFT JOIN says s ON s.image_id IS NOT DISTINCT FROM r.image_id AND s.tool IS NOT DISTINCT FROM r.tool LEFT JOIN images i ON i.image_id = r.image_id LEFT JOIN sizes z ON z.image_id = r.image_id),
runs AS MATERIALIZED (SELECT *, CASE area_unit WHEN 'px' THEN 1.0 WHEN 'kpx' THEN 1000.0 WHEN 'um2' THEN {metric_factor(1.0)} WHEN 'mm2' THEN {metric_factor(1e-6)} ELSE {metric_factor(1e6)} END AS area_factor,
  CASE row_unit WHEN 'px' THEN 1.0 WHEN 'um' THEN 1 / y_um WHEN 'mm' THEN 1e3 / y_um WHEN 'nm' THEN 1e-3 / y_um WHEN 'percent' THEN n_rows / 100.0 ELSE n_rows END AS row_factor
  FROM (SELECT *, coalesce(area_said, {by_ratio}) AS area_unit, coalesce(row_said, {by_rows}) AS row_unit FROM known)),
converted AS (SELECT *, CASE WHEN area = 0 THEN 0.0 WHEN abs(whole - round(whole)) < 0.02 + 1e-3 * whole THEN round(whole) ELSE whole END AS area_px
  FROM (SELECT c.*, area_unit, row_unit, c.area * area_factor AS whole, c.row_ * row_factor AS row_px FROM cells c LEFT JOIN runs r ON r.image_id IS NOT DISTINCT FROM c.image_id AND r.tool IS NOT DISTINCT FROM c.tool))"""


SQL: dict[str, str] = {
    "p2_found": f"""WITH {values_sql()}
SELECT DISTINCT image_id, cell_id, 'area' AS field FROM converted WHERE area_unit <> 'px' AND area <> 0 AND image_id IS NOT NULL AND cell_id IS NOT NULL
UNION ALL SELECT DISTINCT image_id, cell_id, 'centroid_row' FROM converted WHERE row_unit <> 'px' AND row_ IS NOT NULL AND image_id IS NOT NULL AND cell_id IS NOT NULL
UNION ALL SELECT image_id, 0, 'resolution' FROM sizes WHERE v IS NOT NULL AND coalesce(unit, '') <> 'um'""",
    "p2_sizes": f"WITH {values_sql()} SELECT image_id, unit, round(x_um, 6) AS x_um, round(y_um, 6) AS y_um FROM sizes",
    "p2_values": f"WITH {values_sql()} SELECT image_id, cell_id, tool, area_unit, round(area_px, 4) AS area_px, row_unit, round(row_px, 4) AS row_px FROM converted",
}
