"""Quantities recorded in different units, brought to common ones.

Pixel sizes come out in micrometres per pixel, areas and centroid rows in pixels.
The unit is the stated one where a statement exists. Where none does, a calibrated
random forest, trained on the stated cases, predicts it from magnitude, site, scanner or
tool, and neighbouring fields. A confident prediction decides, and an arithmetic check
follows: the area in pixels that ``perimeter`` and ``circularity`` imply, the height of the
image, and the range of pixel sizes of a light microscope. Where the check contradicts the
prediction, or the forest isn't confident, the one unit that the check leaves is taken;
where it leaves several or none, the best guess is converted and ``status`` is ``review``,
which every converted row carries, with the probability.

Defined results: NULL, NaN and infinite values stay NULL and convert to NULL; an
area of 0 stays 0; a pixel size that is not positive is unset; rows without
``image_id`` or ``tool`` form runs of their own (NULL equals NULL); repeated rows are
converted like any other; empty tables give empty results; further columns of the
inputs are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.functions import unittext as U
from histospark.functions.calibrated import CalibratedForest, train
from histospark.runtime import finite, over, stage

#: µm per pixel that a light microscope can have.
PLAUSIBLE = (0.09, 1.2)
#: Calibrated probability from which a prediction counts as confident.
CONFIDENT = 0.9
#: Bound of the labelled rows a forest is fitted on.
MAX_TRAINING_ROWS = 4000

LENGTH_UNITS = ["um", "nm", "mm", "cm", "m", "px/mm", "px/cm", "px/inch"]
AREA_UNITS = ["px", "kpx", "um2", "mm2", "nm2"]
ROW_UNITS = ["px", "um", "mm", "nm", "percent", "fraction"]
_UNKNOWN = -99.0
#: A pixel size in a text: a number and what follows it; a density of pixels; the unit under a key of its own, or in a note.
WRITTEN = rf"(?:^|[;\s=])(?:scale|mpp|pixel_?size|physicalsize[xy]?|res|resolution|auflösung|pixelgröße|pixel size|one pixel|sampled at|sampling|scanned (?:at|with))(?:_[0-9]+)?\s*[:=]?\s*{U.NUMBER}\s*([^;0-9]*)"
DENSITY = rf"{U.NUMBER}\s*((?:{U.DENSITY})[^;]*)"
UNIT_KEY = r"(?:^|; )(?:unit|res_unit|pixel_unit|physicalsizeunit[xy]?)(?:_[0-9]+)?=([^;]*)"
UNIT_NOTE = r"(?:pixel size|pixelgröße|resolution|auflösung)(?: given| recorded| angegeben)? in ([^;]*)"


def _log(c: Column) -> Column:
    """log10 of a positive value; a constant far outside for any other."""
    return F.when(c > 0, F.log10(c)).otherwise(F.lit(_UNKNOWN))


@dataclass
class Settled:
    """``runs`` as of ``run_units``, ``sizes`` as of ``pixel_sizes``, and the forests by field."""

    runs: DataFrame
    sizes: DataFrame
    forests: dict[str, CalibratedForest]


def pixel_sizes(images: DataFrame, runs: DataFrame | None = None, classify: bool = True, forests: dict[str, CalibratedForest] | None = None) -> DataFrame:
    """One row per image: ``image_id, value, unit, stated, x_um, y_um, status, probability``.

    ``value`` is the pixel width as recorded, in ``resolution`` or in a text of ``metadata``;
    ``x_um`` and ``y_um`` are converted, NULL where no size is set. A null or unset height beside
    a width means square pixels, and the reverse. ``runs`` (from ``run_evidence``) gives the size
    that a run's areas in square micrometres imply, as a neighbouring field. The forest is added
    to ``forests``."""
    rx, ry = (finite(F.col(f"resolution.{k}_um")) for k in "xy")
    rx, ry = F.when(rx > 0, rx), F.when(ry > 0, ry)
    text = F.concat_ws(" ; ", F.transform(F.map_entries("metadata"), lambda e: F.concat(U.plain(e["key"]), F.lit("="), F.coalesce(U.plain(e["value"]), F.lit("")))))
    df = images.select("image_id", "site", F.col("metadata")["scanner"].alias("scanner"), rx.alias("_rx"), ry.alias("_ry"), text.alias("_text"))
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract("_text", p, k), F.lit("")) for p in (WRITTEN, DENSITY)])
    df = df.withColumns({"_num": U.number(part(1)), "_num_unit": part(2)})
    stated = F.coalesce(U.length_unit(F.regexp_extract("_text", UNIT_KEY, 1)), U.length_unit(F.regexp_extract("_text", UNIT_NOTE, 1)))
    recorded = F.coalesce("_rx", "_ry")
    own = F.when(F.col("_num") > 0, F.col("_num"))
    df = df.withColumns(
        {
            "value": F.coalesce(recorded, own),
            "_height": F.when(recorded.isNotNull(), F.coalesce("_ry", "_rx")).otherwise(own),
            "stated": F.when(recorded.isNotNull(), stated).when(own.isNotNull(), F.coalesce(U.length_unit(F.col("_num_unit")), stated)),
        }
    ).drop("_rx", "_ry", "_text", "_num", "_num_unit")
    if runs is not None:
        df = df.join(runs.where("area_stated = 'um2' and ratio > 0").groupBy(F.col("image_id").alias("_run_image")).agg(F.median(F.sqrt("ratio")).alias("implied_um")), F.col("image_id") == F.col("_run_image"), "left").drop("_run_image")
    else:
        df = df.withColumn("implied_um", F.lit(None).cast("double"))

    plausible = F.filter(F.array(*[F.struct(F.lit(u).alias("unit"), U.to_um(F.col("value"), F.lit(u)).alias("um")) for u in LENGTH_UNITS]), lambda s: s["um"].between(*PLAUSIBLE))
    df = df.withColumn("_plausible", plausible)
    implied = F.filter("_plausible", lambda s: F.abs(s["um"] / F.col("implied_um") - 1) < 0.15)
    # the runs choose among the plausible units and can't rule out all of them
    df = df.withColumn("_fits", F.transform(F.when(F.size(implied) > 0, implied).otherwise(F.col("_plausible")), lambda s: s["unit"])).drop("_plausible")
    if classify:
        df = df.withColumns({"_m": _log(F.col("value")), "_n": _log(F.col("value") / F.col("implied_um"))})
        df = stage(df)
        known = df.where("value is not null and stated is not null")
        forest = train(known, "stated", ["_m", "_n"], ["image_id"], LENGTH_UNITS, ["site", "scanner"], MAX_TRAINING_ROWS)
        if forests is not None:
            forests["resolution"] = forest
        df = forest.predict(df).drop("_m", "_n")
    else:
        df = df.withColumns({"predicted": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")})
    agrees = F.array_contains("_fits", F.col("predicted"))
    by_evidence = F.when(F.array_contains("_fits", F.lit("um")), F.lit("um")).otherwise(F.get("_fits", F.lit(0)))
    unit = F.when(F.col("value").isNull(), None).otherwise(F.coalesce("stated", F.when(agrees & (F.col("probability") >= CONFIDENT), F.col("predicted")), by_evidence, "predicted"))
    sure = F.col("stated").isNotNull() | (F.size("_fits") == 1) | (agrees & (F.col("probability") >= CONFIDENT))
    return df.withColumn("unit", unit).select(
        "image_id",
        "value",
        "unit",
        "stated",
        U.to_um(F.col("value"), F.col("unit")).alias("x_um"),
        U.to_um(F.col("_height"), F.col("unit")).alias("y_um"),
        F.when(F.col("value").isNull(), "unset").when(sure, "converted").otherwise("review").alias("status"),
        F.when(F.col("stated").isNotNull(), 1.0).otherwise(F.col("probability")).alias("probability"),
    )


def _first_unit(c: str, units: list[str]) -> Column:
    """Of a group, the unit named by its statements; of several, one that isn't pixels."""
    named = F.array_position(F.array(*[F.lit(u) for u in units]), F.col(c))
    return F.max(F.when(F.col(c).isNotNull(), F.struct(named.alias("rank"), F.col(c).alias("unit"))))["unit"]


def run_evidence(features: DataFrame, masks: DataFrame) -> DataFrame:
    """One row per run (``image_id, tool``): stated units, and sums that tell of the unstated.

    All aggregates are algebraic, so each task sends one row per run however many rows it has."""
    states, area_unit, row_unit = U.statement(U.plain(F.col("unit_note")))
    area, pixels = finite(F.col("area")), finite(F.col("circularity") * F.col("perimeter") * F.col("perimeter") / (4 * math.pi))
    both = (area > 0) & (pixels > 0)
    row = finite(F.col("centroid_row"))
    fine = F.abs(row * 100 - F.round(row * 100)) > 1e-4 * F.greatest(F.lit(1.0), F.abs(row) * 1e-6)
    seen = features.select("image_id", "tool", area.alias("_a"), F.when(both, area).alias("_ab"), F.when(both, pixels).alias("_px"), row.alias("_r"), F.when(row.isNotNull(), fine.cast("double")).alias("_fine"), F.when(F.col("unit_note").isNotNull() & states, F.struct(area_unit.alias("a"), row_unit.alias("r"))).alias("_u"))
    seen = seen.groupBy("image_id", "tool").agg(
        F.count("*").alias("n"),
        F.sum("_ab").alias("_sa"),
        F.sum("_px").alias("_sp"),
        F.avg("_a").alias("mean_area"),
        F.max("_r").alias("top_row"),
        F.avg("_fine").alias("fine_rows"),
        _first_unit("_u.a", AREA_UNITS).alias("_fa"),
        _first_unit("_u.r", ROW_UNITS).alias("_fr"),
    )
    said = F.concat_ws(" | ", F.map_values(F.map_filter("model_info", lambda k, v: ~k.isin("tool", "method") & ~k.rlike("regist|align|target|tile"))))
    states, area_unit, row_unit = U.statement(U.plain(said))
    made = masks.where("model_info is not null and image_id is not null").select("image_id", F.col("model_info")["tool"].alias("tool"), states.alias("_s"), area_unit.alias("_a"), row_unit.alias("_r")).where("_s")
    made = made.groupBy(F.col("image_id").alias("_mi"), F.col("tool").alias("_mt")).agg(_first_unit("_a", AREA_UNITS).alias("_ma"), _first_unit("_r", ROW_UNITS).alias("_mr"))
    runs = seen.join(made, (F.col("image_id") == F.col("_mi")) & F.col("tool").eqNullSafe(F.col("_mt")), "left")
    return runs.select(
        "image_id", "tool", "n", "mean_area", "top_row", "fine_rows", (F.col("_sa") / F.col("_sp")).alias("ratio"), F.coalesce("_fa", "_ma").alias("area_stated"), F.coalesce("_fr", "_mr").alias("row_stated")
    )


def settle(features: DataFrame, masks: DataFrame, images: DataFrame, classify: bool = True) -> Settled:
    """Units of all runs and images. Evidence and pixel sizes are written, for both are read more than once."""
    evidence = stage(run_evidence(features, masks))
    forests: dict[str, CalibratedForest] = {}
    sizes = stage(pixel_sizes(images, evidence, classify, forests))
    return Settled(run_units(evidence, images, sizes, classify, forests), sizes, forests)


def run_units(runs: DataFrame, images: DataFrame, sizes: DataFrame, classify: bool = True, forests: dict[str, CalibratedForest] | None = None) -> DataFrame:
    """One row per run (of ``run_evidence``) with the units of its areas and centroid rows and the factors to pixels.

    Columns: ``image_id, tool, n, area_unit, area_factor, area_status, area_probability,
    row_unit, row_factor, row_status, row_probability``; a converted value is the recorded one
    times its factor. With ``classify=False`` the evidence alone names unstated units. ``sizes``
    is the result of ``pixel_sizes``; the forests are added to ``forests``."""
    sizes = sizes.select(F.col("image_id").alias("_pi"), "x_um", "y_um")
    frame = images.select(F.col("image_id").alias("_fi"), "site", F.col("n_rows").cast("double").alias("_rows"))
    frame = frame.join(sizes, F.col("_fi") == F.col("_pi"), "left").drop("_pi").groupBy("_fi").agg(F.first("site").alias("site"), F.max("_rows").alias("_rows"), F.max("x_um").alias("x_um"), F.max("y_um").alias("y_um"))
    df = runs.join(frame, F.col("image_id") == F.col("_fi"), "left").drop("_fi")
    pixel = F.col("x_um") * F.col("y_um")
    ratio = F.col("ratio")
    near = lambda of, tol: F.coalesce(F.abs(ratio / of - 1) < tol, F.lit(False))
    metric = lambda k: F.when(pixel.isNotNull(), near(pixel * k, 0.02)).otherwise(F.coalesce((ratio / k).between(PLAUSIBLE[0] ** 2, PLAUSIBLE[1] ** 2), F.lit(False)))
    area_fits = {"px": near(F.lit(1.0), 0.002), "kpx": near(F.lit(1e-3), 0.03), "um2": metric(1.0), "mm2": metric(1e-6), "nm2": metric(1e6)}
    top, height = F.col("top_row"), F.col("_rows")
    fine = F.coalesce(F.col("fine_rows") > 0.1, F.lit(False))
    under = lambda most: F.coalesce(top <= most, F.lit(True))
    row_fits = {
        "px": under(height + 1) & ~fine,
        "um": under((height + 1) * F.coalesce("y_um", F.lit(PLAUSIBLE[1]))) & fine,
        "mm": under((height + 1) * F.coalesce("y_um", F.lit(PLAUSIBLE[1])) * 1e-3) & fine,
        "nm": under((height + 1) * F.coalesce("y_um", F.lit(PLAUSIBLE[1])) * 1e3) & ~under(height + 1),
        "percent": under(100.001) & fine,
        "fraction": under(1.00001) & fine,
    }
    listed = lambda fits: F.filter(F.array(*[F.when(c, F.lit(u)) for u, c in fits.items()]), lambda x: x.isNotNull())
    df = df.withColumns({"_area_fits": listed(area_fits), "_row_fits": listed(row_fits)})
    if classify:
        df = stage(
            df.withColumns(
                {
                    "_q": _log(ratio),
                    "_e": F.when(ratio > 0, F.least(F.abs(F.log10(ratio)), F.lit(20.0))).otherwise(_UNKNOWN),
                    "_p": F.coalesce(F.log10(ratio / pixel), F.lit(_UNKNOWN)),
                    "_m": _log(F.col("mean_area")),
                    "_h": _log(top),
                    "_k": _log(over(top, height)),
                    "_f": F.coalesce(F.col("fine_rows"), F.lit(-1.0)),
                    "_l": F.coalesce((F.log10(over(top, height)) - F.log10("y_um")), F.lit(_UNKNOWN)),
                }
            )
        )
        areas = train(df, "area_stated", ["_q", "_e", "_p", "_m"], ["image_id", "tool"], AREA_UNITS, ["site", "tool"], MAX_TRAINING_ROWS)
        df = areas.predict(df).withColumnsRenamed({"predicted": "_area_predicted", "probability": "_area_probability"})
        rows = train(df, "row_stated", ["_h", "_k", "_f", "_l"], ["image_id", "tool"], ROW_UNITS, ["site", "tool"], MAX_TRAINING_ROWS)
        if forests is not None:
            forests |= {"area": areas, "centroid_row": rows}
        df = rows.predict(df).withColumnsRenamed({"predicted": "_row_predicted", "probability": "_row_probability"})
    else:
        nothing, zero = F.lit(None).cast("string"), F.lit(0.0)
        df = df.withColumns({"_area_predicted": nothing, "_area_probability": zero, "_row_predicted": nothing, "_row_probability": zero})

    def settled(kind: str) -> tuple[Column, Column]:
        fits, predicted, stated = F.col(f"_{kind}_fits"), F.col(f"_{kind}_predicted"), F.col(f"{kind}_stated")
        agrees = F.coalesce(F.array_contains(fits, predicted), F.lit(False))
        # without a statement or evidence pixels are the common case
        unit = F.coalesce(stated, F.when(agrees, predicted), F.get(fits, F.lit(0)), F.when(F.col(f"_{kind}_probability") >= CONFIDENT, predicted), F.lit("px"))
        sure = stated.isNotNull() | (agrees & (F.col(f"_{kind}_probability") >= CONFIDENT)) | (F.size(fits) == 1)
        return unit, F.when(sure, "converted").otherwise("review")

    area_unit, area_status = settled("area")
    row_unit, row_status = settled("row")
    df = df.withColumns({"area_unit": area_unit, "area_status": area_status, "row_unit": row_unit, "row_status": row_status})
    # an unknown pixel size is the one that the run's own areas imply
    scale = {"um2": 1.0, "mm2": 1e-6, "nm2": 1e6}
    by = lambda c, table: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in table.items()])
    area_factor = by("area_unit", {"px": F.lit(1.0), "kpx": F.lit(1000.0)} | {k: F.coalesce(1 / (pixel * s), 1 / ratio) for k, s in scale.items()})
    row_factor = by("row_unit", {"px": F.lit(1.0), "um": 1 / F.col("y_um"), "mm": 1e3 / F.col("y_um"), "nm": 1e-3 / F.col("y_um"), "percent": height / 100, "fraction": height})
    sure = lambda k: F.when(F.col(f"{k}_stated").isNotNull(), 1.0).otherwise(F.col(f"_{k}_probability"))
    return df.select(
        "image_id", "tool", "n", "area_unit", area_factor.alias("area_factor"), "area_status", sure("area").alias("area_probability"), "row_unit", row_factor.alias("row_factor"), "row_status", sure("row").alias("row_probability")
    )


def with_units(features: DataFrame, runs: DataFrame) -> DataFrame:
    """``features`` with the columns ``unit_*`` of their run; joined by run, not broadcast."""
    of_run = ("area_unit", "area_factor", "area_status", "area_probability", "row_unit", "row_factor", "row_status", "row_probability")
    r = runs.select(F.col("image_id").alias("_ri"), F.col("tool").alias("_rt"), *[F.col(c).alias("unit_" + c.removesuffix("_unit")) for c in of_run])
    return features.join(r, F.col("image_id").eqNullSafe(F.col("_ri")) & F.col("tool").eqNullSafe(F.col("_rt")), "left").drop("_ri", "_rt")


def convert_features(features: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``features`` with ``area_px`` and ``centroid_row_px`` beside their own columns.

    ``unit_area_status`` and ``unit_row_status`` are ``review`` where the unit isn't sure."""
    df = with_units(features, runs)
    whole = F.col("area") * F.col("unit_area_factor")
    # an area counts pixels, so a converted one within its rounding of a whole number is that number
    area = F.when(F.col("area") == 0, 0.0).when(F.abs(whole - F.round(whole)) < 0.02 + 1e-3 * whole, F.round(whole)).otherwise(whole)
    return df.withColumns({"area_px": finite(area), "centroid_row_px": finite(F.col("centroid_row") * F.col("unit_row_factor"))})


def other_units(features: DataFrame, settled: Settled) -> DataFrame:
    """``image_id, cell_id, field`` of each value recorded in another unit than the common one."""
    foreign = stage(settled.runs).where("area_unit <> 'px' or row_unit <> 'px'")
    rows = with_units(features.select("image_id", "cell_id", "tool", "area", "centroid_row"), foreign).where("unit_area is not null")
    area, row = finite(F.col("area")), finite(F.col("centroid_row"))
    fields = F.array(F.when((F.col("unit_area") != "px") & area.isNotNull() & (area != 0), F.lit("area")), F.when((F.col("unit_row") != "px") & row.isNotNull(), F.lit("centroid_row")))
    cells = rows.select("image_id", "cell_id", F.explode(F.filter(fields, lambda x: x.isNotNull())).alias("field")).where("image_id is not null and cell_id is not null").distinct()
    sizes = settled.sizes.where("value is not null and unit <> 'um'").select("image_id", F.lit(0).alias("cell_id"), F.lit("resolution").alias("field"))
    return cells.unionByName(sizes)


def to_review(settled: Settled) -> DataFrame:
    """``image_id, tool, field, unit, probability, n``: the runs and images whose unit a person should settle.

    ``n`` is the number of rows of the run; ``tool`` is NULL for pixel sizes."""
    fields = {"area": "area", "row": "centroid_row"}
    parts = [settled.runs.where(f"{k}_status = 'review'").select("image_id", "tool", F.lit(name).alias("field"), F.col(f"{k}_unit").alias("unit"), F.col(f"{k}_probability").alias("probability"), "n") for k, name in fields.items()]
    sizes = settled.sizes.where("status = 'review'").select("image_id", F.lit(None).cast("string").alias("tool"), F.lit("resolution").alias("field"), "unit", "probability", F.lit(1).cast("bigint").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(sizes)


def accuracy(spark: SparkSession, forests: dict[str, CalibratedForest]) -> DataFrame:
    """A row per field: the rows its forest was fitted on, and its accuracy and calibration on those held out."""
    number = lambda v: None if math.isnan(v) else float(v)
    rows = [(k, f.n_training, f.n_held_out, number(f.held_out_accuracy), number(f.calibration_error)) for k, f in sorted(forests.items())]
    return spark.createDataFrame(rows, "field string, n_training int, n_held_out int, held_out_accuracy double, calibration_error double")
