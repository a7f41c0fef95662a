import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.functions import calibrated, unittext
from histospark.operators import units
from histospark.runtime import stage_observed

FEATURES = "image_id bigint, cell_id int, area double, perimeter double, circularity double, centroid_row double, tool string, unit_note string"
MASKS = "image_id bigint, model_info map<string,string>"
IMAGES = "image_id bigint, site string, n_rows int, n_cols int, resolution struct<x_um: double, y_um: double>, metadata map<string,string>, extra string"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_length_units(spark):
    texts = ["µm", "ΜM", "Mikrometer", "nm/px", "NM", "millim.", "cm per pixel", "m/px", "metre", "Pixel je mm", "pixels per cm", "dots per centimetre", "dpi", "px/inch", "foo", None]
    want = ["um", "um", "um", "nm", "nm", "mm", "cm", "m", "m", "px/mm", "px/cm", "px/cm", "px/inch", "px/inch", None, None]
    assert column(spark, texts, lambda c: unittext.length_unit(unittext.plain(c))) == want


def test_statements(spark):
    texts = ["AREA_UNIT=px² POS_UNIT=Pixel", "Fläche: sq. micron; Schwerpunkt: Prozent der Höhe", '{"AREA":"ΜM²","POS":"NM"}', "A [10^3 px], C [share of rows]", "um2 / micron", "centre en millim.  ", "size Quadratnanometer | loc %", "checked", "units(thousand pixels, Mikrometer)", "area=mm2;centroid=rel", ""]
    want = [(True, "px", "px"), (True, "um2", "percent"), (True, "um2", "nm"), (True, "kpx", "fraction"), (True, "um2", "um"), (True, "px", "mm"), (True, "nm2", "percent"), (False, "px", "px"), (True, "kpx", "um"), (True, "mm2", "fraction"), (False, "px", "px")]
    assert [tuple(x) for x in column(spark, texts, lambda c: F.struct(*unittext.statement(unittext.plain(c))))] == want


def images(spark, rows):
    return spark.createDataFrame([(i, "s", 512, 512, *r, "x") for i, r in enumerate(rows)], IMAGES)


def test_pixel_sizes(spark):
    rows = [
        ((0.25, 0.26), {}),
        ((0.25, None), {"unit": "µm"}),
        ((250.0, 250.0), {"unit": "nm"}),
        ((None, None), {"mpp": "0,5 nanometre", "note": "section 12 µm thick"}),
        (None, {"scan_log": "t=1:2;lamp=4;res=2.54e+04 dpi;ok"}),
        ((0.0, -1.0), {"note": "tray 3; pixel size 0.33micron"}),
        ((3e-07, 3e-07), {"note": "Pixelgröße in metre"}),
        ((506.0, 506.0), {"note": "cover glass 0.2 mm"}),
        (None, {"unit": "nm"}),
        ((float("nan"), None), None),
        ((None, 0.4), {}),
        (None, {"note": "objective 20x; scanned with 5000 pixels per mm"}),
    ]
    out = {r.image_id: r for r in units.pixel_sizes(images(spark, rows), classify=False).collect()}
    assert [out[i].unit for i in range(len(rows))] == ["um", "um", "nm", "nm", "px/inch", "um", "m", "nm", None, None, "um", "px/mm"]
    assert [round(out[i].x_um, 6) if out[i].x_um else None for i in range(len(rows))] == [0.25, 0.25, 0.25, 0.0005, 1.0, 0.33, 0.3, 0.506, None, None, 0.4, 0.2]
    assert out[1].y_um == 0.25 and out[8].status == "unset"


def _run(image, tool, factor, row_factor, note, n=12):
    rows = []
    for k in range(n):
        area, perimeter = 100.0 + 37 * k, 40.0 + 5 * k
        rows.append((image, k + 1, area * factor, perimeter, 12.566370614 * area / perimeter**2, (10.25 + 41 * k) * row_factor, tool, note if k == 3 else None))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows, pictures, masks = [], [], []
    pixel = 0.5 * 0.5123
    kinds = [(1.0, "px"), (1e-3, "kpx"), (pixel, "um2"), (pixel * 1e-6, "mm2")]
    for i in range(60):
        factor, unit = kinds[i % 4]
        stated = i < 48
        rows += _run(i, "a", factor, 0.5123 if i % 5 == 0 and stated else 1.0, f"A [{unit}], C [{'um' if i % 5 == 0 else 'px'}]" if stated and i % 2 else None)
        pictures.append(((0.5, 0.5123), {}))
        if stated and not i % 2:
            masks.append((i, {"tool": "a", "method": "m", "comment": f"A [{unit}], C [{'um' if i % 5 == 0 else 'px'}]"}))
    rows += [(99, 1, 0.0, 0.0, None, None, None, None), (99, 2, None, None, None, float("nan"), "a", None), (0, 1, *rows[0][2:])]
    return spark.createDataFrame(rows, FEATURES), spark.createDataFrame(masks + [(None, None), (3, None)], MASKS), images(spark, pictures)


def test_found(spark, tables):
    found = {(r.image_id, r.cell_id, r.field) for r in units.other_units(tables[0], units.settle(*tables)).collect()}
    want = {(i, k + 1, "area") for i in range(60) if i % 4 for k in range(12)} | {(i, k + 1, "centroid_row") for i in range(0, 48, 5) for k in range(12)}
    assert found == want


@pytest.mark.parametrize("classify", [True, False])
def test_converted(spark, tables, classify):
    features, masks, pictures = tables
    out = units.convert_features(features, units.settle(features, masks, pictures, classify).runs).collect()
    assert len(out) == features.count()
    for r in out:
        if r.image_id < 99:
            assert r.area_px == 100 + 37 * (r.cell_id - 1) and abs(r.centroid_row_px - 10.25 - 41 * (r.cell_id - 1)) < 1e-6
    odd = {r.cell_id: r for r in out if r.image_id == 99}
    assert odd[1].area_px == 0 and odd[2].area_px is None and odd[2].centroid_row_px is None


def test_routing(spark, tables):
    settled = units.settle(*tables)
    assert {r.field: r.n_training for r in units.accuracy(spark, settled.forests).collect()} == {"resolution": 0, "area": 35, "centroid_row": 35}
    review = units.to_review(settled).collect()
    assert {(r.image_id, r.field) for r in review} >= {(99, "area")} and all(r.n > 0 for r in review)
    # nothing is stated and neither perimeters nor circularities tell: the best guess goes to review
    blind = tables[0].withColumns({"perimeter": F.lit(None).cast("double"), "unit_note": F.lit(None).cast("string"), "tool": F.lit("b")})
    runs = units.settle(tables[0].unionByName(blind), *tables[1:]).runs.where("tool = 'b'")
    assert {r.area_status for r in runs.collect()} == {"review"}


def test_sizes_see_the_runs(spark, tables, monkeypatch):
    seen, plain = [], units.pixel_sizes
    monkeypatch.setattr(units, "pixel_sizes", lambda images, runs, *rest: seen.append(runs) or plain(images, runs, *rest))
    units.settle(*tables)
    assert seen[0].where("area_stated = 'um2' and ratio > 0").count() == 12


def test_pixel_sizes_by_runs_and_forest(spark):
    # 950 is plausible as nm (0.95) and as px/mm (1.053), 1100 as 1.1 and as 0.909
    stated = [((1.0 * v, 1.0 * v), {"unit": u}) for k in range(60) for v, u in [(920 + k, "px/mm"), (0.3 + k / 200, "um")]]
    pictures = images(spark, stated + [((950.0, 950.0), {}), ((0.4, 0.4), {}), ((0.5, 0.5), {})])
    n = len(stated)
    nothing = spark.createDataFrame([], "image_id bigint, area_stated string, ratio double")
    out = {r.image_id: r for r in units.pixel_sizes(pictures, nothing).collect()}
    assert (out[n].unit, out[n + 1].unit) == ("px/mm", "um") and out[n].status == "converted"
    # areas of a run choose among the plausible units, but an implausible choice is none
    runs = spark.createDataFrame([(0, "um2", 0.909**2), (1, "um2", 9.0)], nothing.schema)
    two = units.pixel_sizes(images(spark, [((1100.0, 1100.0), {}), ((0.5, 0.5), {})]), runs, classify=False).collect()
    assert {r.image_id: r.unit for r in two} == {0: "px/mm", 1: "um"}


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (FEATURES, MASKS, IMAGES)]
    settled = units.settle(*empty)
    assert units.other_units(empty[0], settled).count() == 0 and units.to_review(settled).count() == 0


@pytest.mark.parametrize("labels", [["px", "um"], ["um", "px", "mm"]])
def test_forest_after_an_observed_table(spark, labels):
    """Of two classes the forest's summary would hold the session, which can't be sent once it has observed."""
    _, seen = stage_observed(spark.range(10), n=F.count("*"))
    rows = [(i, labels[i % 2], "s" if i % 2 else None, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, label string, site string, y double")
    model = calibrated.train(df, "label", ["y"], ["k"], labels, ["site"])
    assert seen["n"] == 10 and all(r.predicted == r.label for r in model.predict(df).collect())
    # an unknown category is predicted all the same
    assert model.predict(df.limit(3).withColumn("site", F.lit("new"))).count() == 3 and model.calibration_error < 0.1


def test_held_out_accuracy(spark):
    rows = [(i, "px" if i % 3 else "um", float(i % 3), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, label string, x double, y double")
    model = calibrated.train(df, "label", ["x", "y"], ["k"], ["px", "um", "mm"])
    assert model.held_out_accuracy > 0.95
    out = model.predict(df).collect()
    assert all(r.predicted == r.label for r in out) and all(0 < r.probability < 1 for r in out)
    ends, rates = calibrated.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert rates == sorted(rates) and rates[-1] == 1.0
