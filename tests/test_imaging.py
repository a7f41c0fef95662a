import json
import struct
import sys
import types
import zipfile
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.functions import rasterfiles
from histospark.operators import annotate, backends, evaluate, intensity, labeling, masks, measure, models, order, resample, segment, stencil, tiles
from histospark.plans.image_queries import QUERIES, rounded
from histospark.sources import images as files
from histospark.sources.scene import described, labels_from_arrays, mask_summary, pixels_from_arrays

rng = np.random.default_rng(3)


def dense(df, image, shape, value="label"):
    out = np.zeros(shape)
    for r in df.where(F.col("image_id") == image).collect():
        out[r["row"] - 1, r["col"] - 1] = r[value]
    return out


def binary(spark, arrays):
    return pixels_from_arrays(spark, arrays).select("image_id", "n_rows", "n_cols", "row", "col", F.col("value").cast("int").alias("on"))


@pytest.fixture(scope="module")
def noise():
    return {1: (rng.random((13, 17)) < 0.55).astype(int), 2: (rng.random((9, 70)) < 0.6).astype(int), 5: np.zeros((4, 4), int)}


def test_components_and_holes(spark, noise):
    df = binary(spark, noise).cache()
    found = labeling.components(df.where("on = 1"))
    filled = labeling.fill_holes(df).withColumn("on", F.lit(1))
    for k, a in noise.items():
        assert (dense(found, k, a.shape) == brute.components(a)).all()
        assert (dense(filled, k, a.shape, "on") == brute.fill(a)).all()


def test_distance_and_seeds(spark, noise):
    sparse = {k: ((a + np.roll(a, 1, 0) + np.roll(a, 1, 1)) == 3).astype(int) for k, a in noise.items()}
    df = binary(spark, sparse).cache()
    d = labeling.distance(df)
    for k in (1, 2):
        assert (dense(d, k, sparse[k].shape, "d") == brute.distance(sparse[k])).all()
        assert (dense(labeling.seeds(df, 0.6), k, sparse[k].shape) == brute.seeds(sparse[k], 0.6)).all()
    assert d.where("image_id = 5 and d is not null").count() == 0
    assert labeling.seeds(df).where("image_id = 5").count() == 0


def test_grow(spark):
    labels = {k: np.where(rng.random((11, 12)) < 0.07, rng.integers(1, 5, (11, 12)), 0) for k in (1, 2)}
    allowed = {k: (rng.random((11, 12)) < 0.8).astype(int) for k in (1, 2)}
    df = labels_from_arrays(spark, labels)
    mask = binary(spark, allowed).where("on = 1")
    for steps in (1, 3, None):
        free, held = labeling.grow(df, steps), labeling.grow(df, steps, mask)
        for k in (1, 2):
            assert (dense(free, k, (11, 12)) == brute.grow(labels[k], steps or 99)).all()
            assert (dense(held, k, (11, 12)) == brute.grow(labels[k], steps or 99, allowed[k])).all()


def test_grow_one_step_is_a_plus(spark):
    out = labeling.grow(labels_from_arrays(spark, {1: brute.square((6, 6), (3, 3, 1))}), 1)
    assert {(r["row"], r["col"]) for r in out.collect()} == {(3, 3), (2, 3), (4, 3), (3, 2), (3, 4)}


def test_morphology_operators(spark, noise):
    df = binary(spark, noise)
    for size in (3, 4, 5):
        e, d = stencil.erode(df, size), stencil.dilate(df, size)
        for k, a in noise.items():
            assert (dense(e, k, a.shape, "on") == brute.morph(a, size, np.min)).all()
            assert (dense(d, k, a.shape, "on") == brute.morph(a, size, np.max)).all()


def test_local_means(spark):
    a = rng.random((12, 15))
    px = pixels_from_arrays(spark, {1: a})
    pad = np.pad(a, 3)
    local = np.array([[pad[i : i + 7, j : j + 7].sum() / 49 for j in range(15)] for i in range(12)])
    assert (dense(stencil.adaptive(px, 6, 0.05), 1, a.shape, "on") == (a > local - 0.05)).all()
    m = dense(stencil.mean3(px), 1, a.shape, "value")
    assert np.allclose(m[1:-1, 1:-1], [[a[i - 1 : i + 2, j - 1 : j + 2].mean() for j in range(1, 14)] for i in range(1, 11)])
    assert np.allclose(m[0], a[0]) and np.allclose(m[:, -1], a[:, -1])
    ramp = np.arange(1, 101).reshape(10, 10, order="F") / 100
    assert np.allclose(dense(stencil.mean3(pixels_from_arrays(spark, {1: ramp})), 1, (10, 10), "value"), ramp)
    ones = dense(stencil.integral(pixels_from_arrays(spark, {1: np.ones((3, 3))})), 1, (3, 3), "integral")
    assert ones.diagonal().tolist() == [1, 4, 9]


def test_channels_are_apart(spark):
    a = rng.random((9, 9, 2))
    both = pixels_from_arrays(spark, {1: a})
    on = stencil.adaptive(both, 5, 0.02)
    opened = stencil.opening(both.withColumn("on", (F.col("value") > 0.2).cast("int")), 3)
    for k in (0, 1):
        alone = pixels_from_arrays(spark, {1: a[..., k]})
        assert (dense(on.where(F.col("channel") == k + 1), 1, (9, 9), "on") == dense(stencil.adaptive(alone, 5, 0.02), 1, (9, 9), "on")).all()
        assert (dense(opened.where(F.col("channel") == k + 1), 1, (9, 9), "on") == dense(stencil.opening(alone.withColumn("on", (F.col("value") > 0.2).cast("int")), 3), 1, (9, 9), "on")).all()


def test_resample(spark):
    a = rng.random((9, 7))
    px = pixels_from_arrays(spark, {1: a})
    for s in (0.5, 1.5, 2.0):
        want = brute.resample(a, s)
        out = resample.resample(px, s)
        assert out.count() == want.size
        assert np.allclose(dense(out, 1, want.shape, "value"), want)
    with pytest.raises(ValueError):
        resample.resample(px, 0)


def test_thresholds(spark):
    a = {1: rng.random((20, 20)), 2: np.full((5, 5), 0.5), 3: np.r_[np.full(50, 0.1), np.full(50, 0.9)].reshape(10, 10)}
    px = pixels_from_arrays(spark, a)
    t = {r.image_id: r.threshold for r in intensity.otsu(px).collect()}
    assert all(abs(t[k] - brute.otsu(v)) < 1e-9 for k, v in a.items())
    t = {r.image_id: r.threshold for r in intensity.triangle(px).collect()}
    assert t[2] == 0.5 and 0.1 < t[3] < 0.9


def test_contrast(spark):
    a = np.stack([rng.random((8, 8)), rng.random((8, 8)) * 3], axis=2)
    px = pixels_from_arrays(spark, {1: a, 2: np.full((4, 4), 0.4)})
    s = intensity.contrast_stretch(px)
    assert np.allclose(dense(s.where("channel = 2"), 1, (8, 8), "value"), (a[..., 1] - a.min()) / (a.max() - a.min()))
    for f in (intensity.contrast_stretch, intensity.equalize, intensity.reinhard):
        assert np.allclose(dense(f(px), 2, (4, 4), "value"), 0.4)
    x = a[..., 0]
    assert np.allclose(dense(intensity.reinhard(px).where("channel = 1"), 1, (8, 8), "value"), np.clip((x - x.mean()) / x.std(ddof=1) * 0.15 + 0.5, 0, 1))
    e = dense(intensity.equalize(px).where("channel = 1"), 1, (8, 8), "value")
    assert e.min() == 0 and e.max() == 1 and (np.argsort(e.ravel(), kind="stable") == np.argsort(np.round(e.ravel(), 12), kind="stable")).all()


def test_stains(spark):
    a = rng.random((10, 10, 3)) * 0.9 + 0.05
    px = pixels_from_arrays(spark, {1: a, 2: np.full((5, 5, 3), 1 - 1e-9)})
    od = -np.log(np.clip(a, 1e-6, 1)).reshape(-1, 3) @ np.linalg.inv(np.array(intensity.RUIFROK))
    out = intensity.deconvolve(px, "ruifrok")
    for k, name in enumerate(("hematoxylin", "eosin", "residual")):
        assert np.allclose(dense(out.where(F.col("stain") == name), 1, (10, 10), "value"), np.maximum(od[:, k], 0).reshape(10, 10))
    m = {r.image_id: np.array(r.stains) for r in intensity.macenko_stains(px).collect()}
    assert np.allclose(m[2], intensity.RUIFROK) and np.allclose(np.linalg.norm(m[1], axis=0), 1)
    with pytest.raises(ValueError):
        intensity.deconvolve(px, stains=np.ones((3, 3)))


def test_segmentations(spark):
    a = {k: np.where(brute.square((24, 24), (3, 9, 1), (13, 21, 1)) > 0, 0.8, 0.1) + rng.random((24, 24)) * 0.05 for k in (1, 2)}
    a[1][5, 5] = 0.1
    px = pixels_from_arrays(spark, a)
    out = segment.threshold(px, open_size=3, min_area=10)
    water = segment.watershed(px, h=0.97)
    for k, x in a.items():
        on = (x > brute.otsu(x)).astype(int)
        opened = brute.morph(brute.morph(on, 3, np.min), 3, np.max)
        assert (dense(out, k, x.shape) == brute.by_area(brute.components(brute.fill(opened)), 10, 5000)).all()
        assert (dense(water, k, x.shape) == brute.grow(brute.grow(brute.seeds(on, 0.97), 24), 3)).all()
    nuclei = labels_from_arrays(spark, {k: brute.square((24, 24), (5, 6, 1), (15, 16, 2)) for k in a})
    p = segment.propagate(nuclei, px, expand_max=4)
    want = brute.grow(brute.square((24, 24), (5, 6, 1), (15, 16, 2)), 4, a[2] < np.quantile(a[2], 0.9))
    assert (dense(p, 2, (24, 24)) == want).all()
    with pytest.raises(ValueError):
        segment.propagate(nuclei, px, lam=-1)
    with pytest.raises(ValueError):
        segment.channel(px, 2, 1)
    assert segment.threshold(pixels_from_arrays(spark, {1: np.full((9, 9), 0.3)})).count() == 0


def test_features(spark):
    two = brute.square((20, 20), (3, 8, 1), (12, 18, 2))
    gap = np.where(two == 2, 3, two)
    px = pixels_from_arrays(spark, {1: np.stack([rng.random((20, 20))] * 2, axis=2), 2: rng.random((20, 20, 2))})
    f = {(r.image_id, r.cell_id): r for r in measure.extract_features(px, labels_from_arrays(spark, {1: two, 2: gap}), ["DAPI", "CD3"]).collect()}
    assert sorted(f) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    r = f[1, 1]
    assert (r.area, r.perimeter, r.eccentricity, round(r.solidity, 6)) == (36, 20, 0, 1.44) and abs(r.circularity - 36 * 4 * np.pi / 400) < 1e-9
    assert (r.centroid_row, r.centroid_col) == (5.5, 5.5) and f[1, 2].area == 49
    assert f[2, 2].area is None and f[2, 2].DAPI_mean is None
    only = measure.extract_features(px, labels_from_arrays(spark, {1: two}), ["DAPI", "CD3"], ("intensity",), [2])
    assert only.columns == ["image_id", "cell_id", *[f"CD3_{s}" for s in ("mean", "sd", "median", "min", "max", "q25", "q75")]]
    dot = measure.extract_features(px, labels_from_arrays(spark, {1: brute.square((20, 20), (5, 5, 1))}), ["DAPI", "CD3"]).first()
    assert (dot.DAPI_entropy, dot.DAPI_iqr, dot.eccentricity, dot.DAPI_sd) == (0, 0, None, None) and dot.solidity == 1
    with pytest.raises(ValueError):
        measure.extract_features(px, labels_from_arrays(spark, {1: two}), ["DAPI", "CD3"], channels=["CD9"])


def test_hulls(spark):
    shape = (15, 15)
    a = {k: (rng.random(shape) < 0.3).astype(int) for k in range(4)}
    for r in measure.hulls(labels_from_arrays(spark, a)).collect():
        points = np.argwhere(a[r.image_id])[:, ::-1] + 1
        ring = np.array([(p.x, p.y) for p in r.ring])
        nxt = np.roll(ring, -1, 0)
        for p in points:  # all points on one side of every edge
            assert ((nxt[:, 0] - ring[:, 0]) * (p[1] - ring[:, 1]) - (nxt[:, 1] - ring[:, 1]) * (p[0] - ring[:, 0]) >= -1e-9).all()
    for _ in range(200):  # many cells at once, against a chain for each
        h, w = rng.integers(1, 12, 2)
        kinds = [(rng.random((h, w)) < rng.random()).astype(int) for _ in range(4)]
        cells = [np.argwhere(k) for k in kinds if k.any()]
        if not cells:
            continue
        ends = [(i, r, *np.sort(p[p[:, 0] == r, 1])[[0, -1]]) for i, p in enumerate(cells) for r in np.unique(p[:, 0])]
        who, x, y, twice = measure.rings(*np.array(ends).T)
        for i, p in enumerate(cells):
            want = brute.hull(p[:, 1], p[:, 0])
            assert list(zip(x[who == i].tolist(), y[who == i].tolist())) == want
            q = np.array(want)
            assert twice[i] == abs(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1)))
    line = labels_from_arrays(spark, {1: np.eye(5, dtype=int)})
    assert measure.hulls(line).first().hull_area == 0 and measure.polygons(line).count() == 0
    assert len(measure.simplified(np.array([(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)], float), 1.0)) == 4


def test_mask_operations(spark):
    border = labels_from_arrays(spark, {1: brute.square((20, 20), (1, 5, 1), (10, 14, 2))})
    assert [r.label for r in masks.edge_cells(border).collect()] == [1]
    kept = masks.filter_cells(border, "remove", min_area=5)
    assert kept.select("label").distinct().collect()[0].label == 1 and kept.count() == 25
    two = labels_from_arrays(spark, {1: brute.square((20, 20), (3, 5, 1), (10, 18, 2))})
    assert masks.filter_cells(two).count() == 81
    assert sorted(r.area for r in measure.moments(two).collect()) == [9, 81]
    nuclei = labels_from_arrays(spark, {1: brute.square((20, 20), (5, 7, 1), (14, 16, 2))})
    cells = brute.square((20, 20), (3, 9, 1), (12, 18, 2))
    merged = masks.merge_assign(nuclei, labels_from_arrays(spark, {1: cells}))
    assert (dense(merged, 1, (20, 20)) == brute.square((20, 20), (5, 7, 1), (14, 16, 2))).all()
    grown = masks.merge_expand(nuclei, labels_from_arrays(spark, {1: cells}))
    assert (dense(grown, 1, (20, 20)) == cells).all()
    assert mask_summary(two).first().n_cells == 2
    tri = brute.square((10, 10), (1, 2, 1), (5, 9, 2))
    assert (dense(labeling.filter_by_area(labels_from_arrays(spark, {1: tri}), 10), 1, (10, 10)) == (tri == 2)).all()


CORRECTIONS = "image_id bigint, seq int, action string, cell_id int, cell_ids array<int>, points array<struct<row: int, col: int>>"


def test_corrections(spark):
    two = brute.square((20, 20), (3, 8, 1), (12, 18, 2))
    make = lambda *rows: spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], CORRECTIONS)
    run = lambda *rows: dense(masks.apply_corrections(labels_from_arrays(spark, {1: two}), make(*rows)), 1, (20, 20))
    assert (run(("delete", 2, None, None)) == (two == 1)).all()
    assert (run(("merge", None, [1, 2], None)) == (two > 0)).all()
    added = run(("add", None, None, [(15, 15), (16, 16), (30, 1)]), ("delete", 1, None, None))
    assert added[14, 14] == added[15, 15] == 2 and added[13, 13] == 1 and added[4, 4] == 0
    one = brute.square((20, 20), (3, 18, 1))
    split = dense(masks.apply_corrections(labels_from_arrays(spark, {1: one}), make(("split", 1, None, [(5, 5), (15, 15)]))), 1, (20, 20))
    seeds = brute.square((20, 20), (5, 5, 1), (15, 15, 2))
    assert (split == brute.grow(seeds, 20, one)).all()
    for bad in (("paint", 1, None, None), ("merge", None, [1], None), ("delete", None, None, None)):
        with pytest.raises(ValueError):
            run(bad)


def test_evaluation(spark):
    images = spark.createDataFrame([(i,) for i in range(4)], "image_id bigint")
    p, g = brute.square((20, 20), (3, 8, 1), (12, 18, 2)), brute.square((20, 20), (3, 9, 1), (12, 17, 2))
    none = np.zeros((20, 20), int)
    found = evaluate.evaluate(labels_from_arrays(spark, {0: p, 1: p, 2: none, 3: none}), labels_from_arrays(spark, {0: g, 1: p, 2: none, 3: brute.square((20, 20), (3, 8, 1))}), images)
    v = {(r.image_id, r.metric): r.value for r in found.collect()}
    assert [round(v[0, m], 6) for m in evaluate.METRICS] == [0.847059, 0.734694, 0.734694, 0.734694, 1, 0, 1]
    assert all(v[k, m] == 1 for k in (1, 2) for m in evaluate.METRICS)
    assert all(v[3, m] == 0 for m in evaluate.METRICS)


def test_patches(spark):
    images = spark.createDataFrame([(1, 100, 100), (2, 20, 30)], "image_id bigint, n_rows int, n_cols int")
    grid = annotate.patch_grid(images, 4, 32)
    assert [(r.row_start, r.row_end, r.col_start) for r in grid.where("image_id = 1").orderBy("patch_id").collect()] == [(1, 32, 1), (69, 100, 1), (1, 32, 69), (69, 100, 69)]
    assert grid.where("image_id = 2 and row_end = 20").count() == grid.where("image_id = 2").count()
    mask = labels_from_arrays(spark, {1: brute.square((6, 6), (2, 4, 1))})
    six = spark.createDataFrame([(1, 6, 6)], "image_id bigint, n_rows int, n_cols int")
    assert abs(annotate.annotation_task(six, mask, n_patches=1, patch_size=6).first().score - 8 / 9) < 1e-9
    with pytest.raises(ValueError):
        annotate.annotation_task(six, region=(1, 2, 3))
    assert annotate.active_rounds(grid, 3).count() == 3 * grid.count()


def test_files(spark, tmp_path):
    a = np.round(rng.random((5, 7, 3)) * 255).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(rasterfiles.encode_png(a))
    (tmp_path / "in" / "b.ppm").write_bytes(b"P6\n# c\n7 5\n255\n" + a.tobytes())
    (tmp_path / "in" / "c.tif").write_bytes(rasterfiles.encode_tiff(a[..., 0] / 255))
    px = files.read_images(spark, str(tmp_path / "in")).toPandas()
    for path, g in px.groupby("path"):
        want = a if not path.endswith("tif") else a[..., :1]
        assert np.allclose(files.to_array(g), want / 255, atol=1e-4)
    with pytest.raises(FileNotFoundError):
        files.read_images(spark, str(tmp_path / "none.png"))
    two = labels_from_arrays(spark, {7: brute.square((20, 20), (3, 5, 1), (10, 18, 2))})
    out = files.export_mask(two, str(tmp_path / "csv"), "csv")
    table = spark.read.csv(out, header=True, inferSchema=True)
    assert sorted(r.area for r in table.collect()) == [9, 81] and table.columns[-1] == "cell_id"
    files.export_mask(two, str(tmp_path / "q"), "qupath")
    fc = json.loads((tmp_path / "q" / "7.geojson").read_text())
    assert [p.name for p in (tmp_path / "q").iterdir()] == ["7.geojson"]
    ring = fc["features"][0]["geometry"]["coordinates"][0]
    assert fc["type"] == "FeatureCollection" and fc["features"][0]["id"] == "cell-1" and ring[0] == ring[-1] and len(ring) == 5
    files.export_mask(two, str(tmp_path / "t"), "tiff")
    back = rasterfiles.decode((tmp_path / "t" / "7.tif").read_bytes())[..., 0]
    assert np.allclose(back * 2, brute.square((20, 20), (3, 5, 1), (10, 18, 2)), atol=1e-4)
    files.export_mask(two, str(tmp_path / "p"), "png")
    assert rasterfiles.decode((tmp_path / "p" / "7.png").read_bytes()).shape == (20, 20, 3)
    with pytest.raises(ValueError):
        files.export_mask(two, str(tmp_path / "x"), "bmp")


def _jvm_picture(spark, a, path, kind, packing=None, side=None):
    """``a`` (rows, columns, 3) as a file written by the JVM's own codecs."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 5)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            picture.setRGB(c, r, int(a[r, c, 0]) << 16 | int(a[r, c, 1]) << 8 | int(a[r, c, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    how = writer.getDefaultWriteParam()
    if packing:
        how.setCompressionMode(2)
        how.setCompressionType(packing)
    if side:
        how.setTilingMode(2)
        how.setTiling(side, side, 0, 0)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    out.close()


def test_common_files(spark, tmp_path):
    a = np.add.outer(np.arange(37) * 3, np.arange(45) * 2)[..., None] % np.array([200, 150, 90])
    for packing in ("LZW", "Deflate", "ZLib", "PackBits", None):
        for side in (None, 16):
            _jvm_picture(spark, a, tmp_path / "x.tif", "tiff", packing, side)
            assert np.allclose(rasterfiles.decode((tmp_path / "x.tif").read_bytes()) * 255, a)
    noise = rng.integers(0, 256, (90, 70, 3))
    _jvm_picture(spark, noise, tmp_path / "n.tif", "tiff", "LZW")
    assert np.allclose(rasterfiles.decode((tmp_path / "n.tif").read_bytes()) * 255, noise)
    folder = tmp_path / "in"
    folder.mkdir()
    _jvm_picture(spark, a, folder / "a.bmp", "bmp")
    _jvm_picture(spark, a * 0 + 120, folder / "b.jpg", "jpeg")
    _jvm_picture(spark, a, folder / "c.png", "png")
    px = files.read_images(spark, str(folder)).toPandas()
    for path, g in px.groupby("path"):
        assert np.allclose(files.to_array(g) * 255, 120 if path.endswith("jpg") else a, atol=2 if path.endswith("jpg") else 1e-6)
    assert px.path.nunique() == 3 and px.image_id.nunique() == 3
    (folder / "d.svs").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.read_images(spark, str(folder))


def test_png_of_few_bits_and_interlaced():
    a = rng.integers(0, 2, (11, 13))
    lines = b"".join(b"\0" + np.packbits(row.astype(np.uint8)).tobytes() for row in a)

    def png(body, depth, colour, laced, h, w):
        chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    assert (rasterfiles.decode(png(lines, 1, 0, 0, 11, 13))[..., 0] == a).all()
    b = rng.integers(0, 256, (11, 13, 3)).astype(np.uint8)
    body = b""
    for r0, c0, dr, dc in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)):
        for row in b[r0::dr, c0::dc]:
            if row.size:
                body += b"\0" + row.tobytes()
    assert np.allclose(rasterfiles.decode(png(body, 8, 2, 1, 11, 13)) * 255, b)
    # filters that look left and up
    for kind in (1, 2, 3, 4):
        body, before = b"", np.zeros(39, int)
        for row in b.reshape(11, 39).astype(int):
            left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, before[:-3]])
            p = left + before - corner
            near = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
            paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], before, corner))
            body += bytes([kind]) + ((row - {1: left, 2: before, 3: (left + before) // 2, 4: paeth}[kind]) % 256).astype(np.uint8).tobytes()
            before = row
        assert np.allclose(rasterfiles.decode(png(body, 8, 2, 0, 11, 13)) * 255, b)


def test_sizes_must_agree(spark):
    small, large = labels_from_arrays(spark, {1: brute.square((10, 10), (3, 5, 1))}), labels_from_arrays(spark, {1: brute.square((12, 10), (3, 5, 1))})
    px = pixels_from_arrays(spark, {1: np.ones((12, 10))})
    tries = [
        lambda: evaluate.evaluate(small, large, small),
        lambda: masks.merge_assign(small, large),
        lambda: masks.merge_expand(small, large),
        lambda: measure.extract_features(px, small, ["a"]),
    ]
    for t in tries:
        with pytest.raises(Exception, match="same size"):
            t().collect()
    assert evaluate.evaluate(small, small, small).count() == 7


def test_resolution_and_crop(spark):
    px = pixels_from_arrays(spark, {1: rng.random((8, 8)), 2: rng.random((8, 8))})
    images = described(spark, {1: np.zeros((8, 8)), 2: np.zeros((8, 8, 3))}, resolution={1: (0.5, 0.5)})
    assert [r.channels for r in images.orderBy("image_id").collect()] == [["ch1"], ["ch1", "ch2", "ch3"]]
    with pytest.raises(ValueError):
        described(spark, {1: np.zeros((2, 2))}, channels={1: ["a", "b"]})
    out = intensity.preprocess(px, target_resolution=1.0, images=images)
    assert {r.image_id: r["count"] for r in out.groupBy("image_id").count().collect()} == {1: 16, 2: 64}
    after = {r.image_id: r for r in intensity.preprocessed(images, contrast="stretch", target_resolution=1.0).collect()}
    assert (after[1].n_rows, after[1].resolution.x_um, after[1].history) == (4, 1.0, ["contrast:stretch", "resample:1um"])
    assert (after[2].n_rows, after[2].resolution.x_um, after[2].history) == (8, None, ["contrast:stretch"])
    for bad in (0, -1.0):
        with pytest.raises(ValueError):
            intensity.preprocess(px, target_resolution=bad, images=images)
    part = segment.crop(px, (3, 20), (2, 4))
    assert {(r.n_rows, r.n_cols) for r in part.select("n_rows", "n_cols").distinct().collect()} == {(6, 3)} and part.agg(F.max("row"), F.min("col")).first()[:] == (6, 1)
    assert {(r.n_rows, r.n_cols, len(r.history)) for r in segment.cropped(images, (3, 20), (2, 4)).collect()} == {(6, 3, 0)}
    with pytest.raises(ValueError):
        segment.crop(px, (0, 2), (1, 1))


def test_order(spark):
    n = 6000
    rows = [(int(g), i, float(v)) for i, (g, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], n), np.where(rng.random(n) < 0.5, 7.0, rng.normal(size=n))))] + [(4, -1, 2.5), (5, -2, float("nan")), (5, -3, None)]
    df = spark.createDataFrame(rows, "g int, t int, v double").repartition(6)
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r.g: list(r.q) for r in order.quantiles(df, "g", F.col("v"), ["t"], shares).collect()}
    assert set(got) == {1, 2, 3, 4}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for k, _, v in rows if k == g], shares))
    lone = spark.createDataFrame([(None, 8, 1.0), (None, 3, 1.0)], df.schema)
    places = {(r.g, r.t): r.place for r in order.ranked(df.unionByName(lone), "g", "t", "place").collect()}
    assert (places[None, 3], places[None, 8]) == (1, 2)
    for g in (1, 2, 3, 4, 5):
        assert [places[g, t] for t in sorted(t for k, t, _ in rows if k == g)] == list(range(1, 1 + sum(k == g for k, _, _ in rows)))


def test_random_patches(spark):
    images = spark.createDataFrame([(1, 100, 300), (2, 40, 40)], "image_id bigint, n_rows int, n_cols int")
    out = annotate.patch_random(images, 12, 32).collect()
    assert len(out) == 24 and all(1 <= r.row_start and r.row_end == r.row_start + 31 and r.col_end <= 300 for r in out)
    assert len({r.row_start for r in out if r.image_id == 1}) == 12 and {r.row_start for r in out if r.image_id == 2} <= set(range(1, 10))
    assert out == annotate.patch_random(images, 12, 32).collect() != annotate.patch_random(images, 12, 32, seed=2).collect()


def test_macenko_deconvolution(spark):
    stains = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]])
    stains /= np.linalg.norm(stains, axis=1)[:, None]
    amounts = np.where(rng.random((40, 40, 1)) < 0.5, [1.0, 0.02], [0.02, 1.0]) * rng.uniform(0.3, 1.0, (40, 40, 1))
    px = pixels_from_arrays(spark, {1: np.exp(-amounts @ stains), 2: np.full((3, 3, 3), 1 - 1e-9)}).cache()
    own = {r.image_id: np.array([list(x) for x in r.stains]) for r in intensity.macenko_stains(px).collect()}
    assert np.allclose(own[2], intensity.RUIFROK)
    near = np.abs(own[1].T[:2] @ stains.T)
    assert (near.max(axis=1) > 0.99).all()
    out = intensity.deconvolve(px).where("image_id = 1")
    want = np.maximum(amounts @ stains @ np.linalg.inv(own[1]), 0)
    for k, name in enumerate(intensity.STAINS):
        assert np.allclose(dense(out.where(F.col("stain") == name), 1, (40, 40), "value"), want[..., k])
    with pytest.raises(ValueError):
        intensity.deconvolve(px, "vahadane")


def test_backends(spark):
    px = pixels_from_arrays(spark, {1: np.where(brute.square((8, 8), (2, 4, 1)) > 0, 0.9, 0.1), 2: np.zeros((8, 8))})
    backends.register("bright", lambda image, over=0.5: (image[..., 0] > over).astype(int))
    assert backends.segment(px, "bright", over=0.3).count() == 9
    with pytest.raises(ValueError):
        backends.segment(px, "unknown")
    if not backends.backends()["cellpose"]:
        with pytest.raises(RuntimeError):
            backends.segment(px, "cellpose")
    with pytest.raises(RuntimeError if not backends.backends()["stardist"] else FileNotFoundError):
        backends.segment(px, "stardist", custom_model_path="/none")
    with pytest.raises(FileNotFoundError):
        backends.segment(px, "bright", custom_model_path="/none")
    backends.register("mesmer", lambda image, image_mpp=0.5, compartment="both": {"nuclear": np.full(image.shape[:2], round(image_mpp * 100))})
    two = pixels_from_arrays(spark, {1: np.zeros((2, 2, 2)), 2: np.zeros((2, 2, 2))})
    known = described(spark, {1: np.zeros((2, 2, 2)), 2: np.zeros((2, 2, 2))}, resolution={1: (0.25, 0.25)})
    assert {r.image_id: r.label for r in backends.segment(two, "mesmer", known).collect()} == {1: 25, 2: 50}
    backends._registered.pop("mesmer")
    assert backends.probe(spark, 2).where("backend = 'cellpose'").count() == 1
    with pytest.raises(ValueError):
        backends.train([(np.zeros((3, 3)), np.zeros((4, 4)))])
    assert backends.train([(np.zeros((3, 3)), np.zeros((3, 3)))], trainer=lambda pairs, **k: f"{len(pairs)}-{k['n_epochs']}") == "1-100"


def _stub(monkeypatch, name, **members):
    """A module of that name, and the packages it is in, for this process."""
    parts = name.split(".")
    for i in range(1, len(parts) + 1):
        module = types.ModuleType(".".join(parts[:i]))
        monkeypatch.setitem(sys.modules, module.__name__, module)
        if i > 1:
            setattr(sys.modules[".".join(parts[: i - 1])], parts[i - 1], module)
    for k, v in members.items():
        setattr(sys.modules[name], k, v)


def test_adapters_call_their_libraries(monkeypatch):
    """The built-in backends against stand-ins with the libraries' interfaces."""
    seen = {}
    image = np.stack([np.where(brute.square((9, 9), (2, 4, 1)) > 0, 0.9, 0.1), np.full((9, 9), 0.5)], axis=-1)

    class Cells:
        def __init__(self, **how):
            seen["made"] = how

        def eval(self, x, **how):
            seen["eval"] = how
            return (x[..., 0] > 0.5).astype(np.uint16), None, None

    _stub(monkeypatch, "cellpose.models", Cellpose=Cells, CellposeModel=Cells)
    assert backends._cellpose(image, diameter=12.0, channels=(1, 2), batch_size=4).sum() == 9
    assert seen["made"] == {"model_type": "cyto3"} and seen["eval"]["channels"] == [1, 2] and seen["eval"]["diameter"] == 12.0 and seen["eval"]["batch_size"] == 4
    backends._cellpose(image, custom_model_path="/m/own")
    assert seen["made"] == {"pretrained_model": "/m/own"}

    class Stars:
        def __init__(self, config=None, name=None, basedir=None):
            seen["stars"] = (name, basedir)

        @classmethod
        def from_pretrained(cls, name):
            return cls(None, name)

        def predict_instances(self, x, **how):
            seen["x"], seen["how"] = x, how
            return (x > 0.5).astype(int), {}

    _stub(monkeypatch, "stardist.models", StarDist2D=Stars)
    assert backends._stardist(image, prob_thresh=0.3).sum() == 9 and seen["how"]["prob_thresh"] == 0.3 and (seen["x"].min(), seen["x"].max()) == (0, 1)
    assert backends._stardist(image, channel=2).sum() == 0  # a constant channel stays as it is
    backends._stardist(image, custom_model_path="/m/own")
    assert seen["stars"] == ("own", "/m")

    class Net:
        def predict(self, x, compartment, image_mpp):
            seen["mpp"] = image_mpp
            return np.stack([x[..., 0] > 0.5, x[..., 1] > 0.1], axis=-1).astype(int)[..., : 2 if compartment == "both" else 1]

    _stub(monkeypatch, "deepcell.applications", Mesmer=Net)
    both = backends._mesmer(image, "both", 0.25)
    assert {k: int(v.sum()) for k, v in both.items()} == {"whole-cell": 9, "nuclear": 81} and seen["mpp"] == 0.25
    assert list(backends._mesmer(image)) == ["whole-cell"] and seen["mpp"] == 0.5
    monkeypatch.setattr(backends.importlib.util, "find_spec", lambda name: object())

    class Trained:
        def __init__(self, **how):
            self.net = how

    trained = types.SimpleNamespace(train_seg=lambda net, **how: seen.update(train=(net, how)) or ("/m/new", None))
    _stub(monkeypatch, "cellpose.models", CellposeModel=Trained)
    monkeypatch.setitem(sys.modules, "cellpose.train", trained)
    sys.modules["cellpose"].train = trained
    assert backends.train([(np.zeros((3, 3)), np.zeros((3, 3)))], n_epochs=7) == "/m/new"
    assert seen["train"][0] == {"model_type": "cyto3"} and seen["train"][1]["n_epochs"] == 7


def test_models(spark, tmp_path):
    weights = tmp_path / "w.bin"
    weights.write_bytes(b"abc")
    m = models.TrainedModel(str(weights), "cellpose", "cyto3", {"dice": 0.9, "loss": [3, 2]}, {"tissue": "x"})
    path = models.package(m, str(tmp_path / "out" / "m.zip"), "name")
    back = models.load(path)
    assert back.base_model == "cyto3" and back.training_metrics["dice"] == 0.9 and (tmp_path / "out").exists()
    assert back.training_metrics == m.training_metrics and back.model_card == {"tissue": "x"} and back.created == m.created.replace(microsecond=0, tzinfo=None)
    assert [r[0] for r in m.card_rows()][:4] == ["Backend", "Base Model", "Model Path", "Created"] and ("Metric: loss", "3, 2") in m.card_rows()
    assert "Base model: cyto3" in str(m) and "tissue: x" in m.summary()
    with zipfile.ZipFile(models.package(m, str(tmp_path / "d.zip"), training_data=str(tmp_path / "out"))) as z:
        assert "training/m.zip" in z.namelist() and json.loads(z.read("model_card.json"))["name"] == "cellpose_cyto3"
    assert m.losses(spark).count() == 2 and ("Metric: dice", "0.9") in m.card_rows()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("x", "y")
    with pytest.raises(ValueError):
        models.load(str(tmp_path / "bad.zip"))
    with pytest.raises(ValueError):
        models.TrainedModel("x", "other")


def test_image_isolation(spark):
    a = (rng.random((10, 10)) < 0.5).astype(int)
    alone = labeling.components(binary(spark, {3: a}).where("on = 1"))
    among = labeling.components(binary(spark, {3: a, 4: 1 - a, 9: a}).where("on = 1"))
    assert (dense(alone, 3, a.shape) == dense(among, 3, a.shape)).all()
    assert (dense(among, 9, a.shape) == dense(among, 3, a.shape)).all()


def test_tiles_agree_with_whole_images(spark):
    """Components and growth of images of several tiles, against the same on the whole array."""
    rng = np.random.default_rng(8)
    h, w = tiles.TILE * 2 + 9, tiles.TILE + 70
    on = rng.random((h, w)) < 0.02
    on[:, 300] = on[5, :] = on[tiles.TILE - 1 : tiles.TILE + 1, :200] = True
    on[40:900, tiles.TILE] = on[1000, 10:580] = True
    labels = labels_from_arrays(spark, {3: on.astype(int), 4: np.eye(5)})
    got = labeling.components(labels).toPandas()
    row, c0, c1 = tiles.runs_of(*(x.astype(np.int64) for x in np.nonzero(on)))
    first = tiles.connected(row, c0, c1)
    want = np.zeros((h, w), int)
    for r, a, b, k in zip(row, c0, c1, np.unique(first, return_inverse=True)[1]):
        want[r, a : b + 1] = k + 1
    out = np.zeros((h, w), int)
    big = got[got.image_id == 3]
    out[big.row - 1, big.col - 1] = big.label
    assert (out == want).all() and len(got[got.image_id == 4]) == 5
    seeds = np.zeros((h, w), np.int32)
    seeds[rng.integers(0, h, 12), rng.integers(0, w, 12)] = np.arange(1, 13)
    free = rng.random((h, w)) < 0.8
    marks, mask = labels_from_arrays(spark, {3: seeds}), labels_from_arrays(spark, {3: free.astype(int), 9: np.ones((3, 3))})
    whole = np.where(seeds > 0, seeds, np.where(free, 0, -1)).astype(np.int32)
    for steps in (tiles.HALO * 2 + 5, None):
        grown = labeling.grow(marks, steps, mask).toPandas()
        out = np.full((h, w), 0, np.int32)
        out[grown.row - 1, grown.col - 1] = grown.label
        assert (out == np.maximum(tiles.spread(whole, steps or h), 0)).all() and set(grown.image_id) == {3}
    dense = pixels_from_arrays(spark, {3: on.astype(float)}).withColumn("on", F.col("value").cast("int")).drop("value", "channel")
    opened = stencil.opening(dense, 3).where("on = 1").count()
    ring = tiles.inside((h, w), 0, 0, h, w, 1)
    assert opened == np.where(ring, tiles.extreme(np.where(ring, tiles.extreme(on.astype(int), 1, False), 0), 1, True), 0).sum()


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def shuffled_per_pixel(spark, tmp_path, name):
    """Bytes a pixel that a query of an image's pixels exchanges where no table is small enough to be sent to all."""
    spark.range(1500).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return (shuffled(spark) - before) / (100 * 64 * 64)


def by_place(df):
    return {tuple(r)[:-1]: r.value for r in df.select("image_id", "n_rows", "n_cols", "row", "col", "channel", "value").collect()}


def test_preprocess_exchanges_no_pixels(spark, tmp_path):
    assert shuffled_per_pixel(spark, tmp_path, "preprocess") < 0.5


def test_preprocess_resolution_exchanges_no_pixels(spark, tmp_path):
    assert shuffled_per_pixel(spark, tmp_path, "preprocess_resolution") < 5


def test_deconvolve_macenko_exchanges_no_pixels(spark, tmp_path):
    assert shuffled_per_pixel(spark, tmp_path, "deconvolve_macenko") < 5


def test_deconvolution_of_several_tiles_and_of_one(spark):
    images = {1: rng.random((515, 6, 3)), 2: rng.random((20, 30, 4))}
    px = pixels_from_arrays(spark, images).cache()
    own = {r.image_id: np.array([list(x) for x in r.stains]) for r in intensity.macenko_stains(px).collect()}
    got = intensity.deconvolve(px).toPandas()
    for image, a in images.items():
        want = np.maximum(-np.log(np.maximum(a[..., :3], 1e-6)) @ np.linalg.inv(own[image]), 0)
        rows = got[got.image_id == image]
        assert len(rows) == want.size
        assert np.allclose(want[rows.row - 1, rows.col - 1, rows.stain.map(intensity.STAINS.index)], rows.value, atol=1e-7)


def test_preprocess_equals_its_steps_on_rows(spark):
    images = {1: rng.random((40, 30, 3)), 2: rng.random((515, 530, 2)), 3: np.full((5, 7, 2), 0.3), 4: rng.random((1, 9, 2)), 5: rng.random((2, 2))}
    px = pixels_from_arrays(spark, images)
    px = px.withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 5) % 97 != 0, F.col("value"))).cache()
    by_image = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 2.0), (4, 0.3), (5, 1.0)], "image_id bigint, scale double")
    steps = stencil.mean3(intensity.reinhard(px)), {"stain": "reinhard", "denoise": True}
    for of, (want, how) in enumerate([(intensity.contrast_stretch(steps[0]), steps[1] | {"contrast": "stretch"}), (px, {})]):
        tries = [(resample.resample(want, 0.6), {"scale": 0.6})] if of else [(want, {})]
        for rows, more in tries:
            want_, got = by_place(rows), by_place(intensity.preprocess(px, **how, **more))
            assert want_.keys() == got.keys()
            assert all((a is None) == (got[k] is None) and (a is None or abs(a - got[k]) < 1e-9) for k, a in want_.items())
    sizes = described(spark, images, resolution={k: (s, s) for k, s in ((1, 0.5), (2, 0.7), (3, 2.0), (4, 0.3))})
    want, got = by_place(resample.resample(px, by_image)), by_place(intensity.preprocess(px, target_resolution=1.0, images=sizes))
    assert want.keys() == got.keys() and {k for k, a in want.items() if a is None} == {k for k, a in got.items() if a is None}
    assert max(abs(a - got[k]) for k, a in want.items() if a is not None) < 1e-9


def test_rounded(spark):
    values = [0.0000005, -0.0000005, 1.0000005, 0.1234565, 0.12345649999, 2.5, -0.3, 1e20, 1e9 + 0.1, float("nan"), float("inf"), None, -0.0, *rng.normal(size=500).tolist(), *(np.arange(500) / 16000).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 6, 10):
        assert df.where(~rounded("v", digits).eqNullSafe(F.round("v", digits))).count() == 0
