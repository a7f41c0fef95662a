"""Queries of the imaging operators over rasters derived from ``customer`` and ``embeddings``."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.functions import rasterfiles
from histospark.operators import annotate, evaluate, intensity, labeling, masks, measure, models, resample, segment, stencil, tiles
from histospark.plans import plotdata, printing
from histospark.plans import scene_sql as S
from histospark.runtime import load, stage
from histospark.sources import images as files
from histospark.sources import scene

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AT = ["image_id", "row", "col"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(c: Column | str, digits: int) -> Column:
    """``round``, which goes by decimal numbers only where a value is near a tie, too large or not finite."""
    c = F.col(c) if isinstance(c, str) else c
    y = c * float(10**digits)
    clear = (F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(clear, F.floor(y + 0.5) / float(10**digits)).otherwise(F.round(c, digits))


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return stage(scene.scene_labels(_customer(spark, d)))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return stage(scene.predicted_labels(_customer(spark, d)))


def _pixels(spark: SparkSession, d: str, channels: int = 1) -> DataFrame:
    # written once, as images would be, for operators read their input more than once
    return stage(scene.scene_pixels(_customer(spark, d), channels))


def _rasters(spark: SparkSession, d: str, channels: int) -> DataFrame:
    return scene.scene_rasters(_customer(spark, d), channels)


def _images(spark: SparkSession, d: str) -> DataFrame:
    return scene.scene_images(_customer(spark, d))


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return scene.embedding_pixels(load(spark, d, "embeddings"))


def _dense(spark: SparkSession, d: str, on: Column) -> DataFrame:
    """Every pixel of the scene with ``on`` as 0 or 1."""
    return stage(tiles.dense(scene.scene_labels(_customer(spark, d)), _images(spark, d)).withColumn("on", on.cast("int")).drop("label"))


def _holed() -> Column:
    return (F.col("label") > 0) & ((F.col("row") * 7 + F.col("col") * 13 + F.col("image_id")) % 11 != 0)


_HOLED_SQL = "holed AS (SELECT image_id, r, c, CAST(label > 0 AND (r * 7 + c * 13 + image_id) % 11 <> 0 AS INTEGER) AS v FROM px WHERE ch = 1)"


# sources


@query(f'WITH {S.SCENE} SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel, round(v / 1000.0, 6) AS value FROM px WHERE ch <= 2')
def scene_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, 2).select(*AT, "channel", r6("value").alias("value"))


@query(f'WITH {S.LABELS} SELECT image_id, r AS "row", c AS "col", label FROM cell_px')
def scene_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select(*AT, "label")


@query(f"WITH {S.LABELS} SELECT image_id, 64 AS n_rows, 64 AS n_cols, max(label) AS n_cells FROM cell_px GROUP BY image_id")
def mask_summary(spark: SparkSession, d: str) -> DataFrame:
    return scene.mask_summary(_labels(spark, d))


@query(f'WITH {S.EMB} SELECT image_id, r AS "row", c AS "col", round(value, 6) AS value FROM emb')
def embedding_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _raster(spark, d).select(*AT, r6("value").alias("value"))


def _examples_sql() -> str:
    rows = ", ".join(f"({image}, {n}, {ground}, {low}, {high}, {noise}, {len(names)})" for image, n, ground, low, high, noise, names in scene.EXAMPLES.values())
    return f"""kinds AS (SELECT * FROM (VALUES {rows}) AS t(image_id, n, ground, low, high, noise, channels)),
spots AS (SELECT image_id, CAST(k AS INTEGER) AS k, 4 + (k * 37 + image_id * 29) % 57 AS cr, 4 + (k * 53 + image_id * 3) % 57 AS cc, 3 + (k + image_id) % 5 AS rx, 3 + (k * 2 + image_id) % 5 AS ry FROM kinds, range(1, 21) AS x(k) WHERE k <= n),
marked AS (SELECT image_id, r, c, max(k) AS label FROM spots, range(1, 65) AS a(r), range(1, 65) AS b(c) WHERE (r - cr) * (r - cr) * ry * ry + (c - cc) * (c - cc) * rx * rx <= rx * rx * ry * ry GROUP BY ALL)"""


@query(f"""WITH {_examples_sql()}, vals AS (
  SELECT e.image_id, r, c, ch, CASE WHEN label IS NOT NULL THEN low + (label * 97 + ch * 41) % (high - low + 1) ELSE ground END + floor(((r * 31 + c * 17 + ch * 7) % 21 - 10) * noise / 10.0) AS v
  FROM kinds e CROSS JOIN range(1, 65) AS a(r) CROSS JOIN range(1, 65) AS b(c) JOIN range(1, 5) AS h(ch) ON ch <= channels LEFT JOIN marked USING (image_id, r, c))
SELECT CAST(image_id AS BIGINT) AS image_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col", CAST(ch AS INTEGER) AS channel, round(least(greatest(v, 0), 1000) / 1000.0, 6) AS value FROM vals""")
def example_pixels(spark: SparkSession, d: str) -> DataFrame:
    one, two, three = (scene.example_pixels(spark, k) for k in scene.EXAMPLES)
    return one.unionByName(two).unionByName(three).select(*AT, "channel", r6("value").alias("value"))


@query(f"""WITH {_examples_sql()} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col", label FROM marked""")
def example_labels(spark: SparkSession, d: str) -> DataFrame:
    one, two, three = (scene.example_labels(spark, k) for k in scene.EXAMPLES)
    return one.unionByName(two).unionByName(three).select(*AT, "label")


@query("""SELECT CAST(i AS BIGINT) AS image_id, t AS type, x AS text FROM (VALUES (1, 'he_breast', '64 x 64 (1 channel)'), (2, 'fluorescence_nuclei', '64 x 64 (1 channel)'), (3, 'multiplex_4ch', '64 x 64 x 4 (4 channels: DAPI, CD3, CD8, PanCK)')) AS v(i, t, x)""")
def example_images(spark: SparkSession, d: str) -> DataFrame:
    images = scene.example_images(spark)
    return printing.image_lines(images).join(images.select("image_id", F.col("metadata")["type"].alias("type")), "image_id").select("image_id", "type", "text")


# projection and filters


@query(f'WITH {S.SCENE} SELECT image_id, CAST(r - 9 AS INTEGER) AS "row", CAST(c - 19 AS INTEGER) AS "col", CAST(ch AS INTEGER) AS channel, round(v / 1000.0, 6) AS value FROM px WHERE ch <= 2 AND r BETWEEN 10 AND 40 AND c BETWEEN 20 AND 50')
def crop(spark: SparkSession, d: str) -> DataFrame:
    px = segment.crop(_pixels(spark, d, 2), (10, 40), (20, 50))
    return px.select(*AT, "channel", r6("value").alias("value"))


@query(f'WITH {S.SCENE} SELECT image_id, r AS "row", c AS "col", round(v / 1000.0, 6) AS value FROM px WHERE ch = 2')
def channel_select(spark: SparkSession, d: str) -> DataFrame:
    return segment.channel(_pixels(spark, d, 3), 2, 3).select(*AT, r6("value").alias("value"))


@query(f'WITH {S.SCENE} SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel, round(-ln(least(greatest(v / 1000.0, 1e-6), 1)), 6) AS od FROM px WHERE ch <= 3')
def optical_density(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d, 3).select(*AT, "channel", r6(intensity.optical_density(F.col("value"))).alias("od"))


@query(f"""WITH {S.SHAPES}, kept AS (
  SELECT image_id, label FROM cell_shape WHERE area BETWEEN 50 AND 5000 AND coalesce(circularity >= 0.3, true) AND coalesce(eccentricity <= 0.95, true)
),
inner_ AS (SELECT image_id, label FROM cell_px GROUP BY ALL HAVING min(r) > 1 AND max(r) < 64 AND min(c) > 1 AND max(c) < 64),
renamed AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INTEGER) AS new FROM kept SEMI JOIN inner_ USING (image_id, label))
SELECT p.image_id, r AS "row", c AS "col", new AS label FROM cell_px p JOIN renamed USING (image_id, label)""")
def filter_cells(spark: SparkSession, d: str) -> DataFrame:
    return masks.filter_cells(_labels(spark, d), "remove", min_area=50, max_area=5000, min_circularity=0.3, max_eccentricity=0.95).select(*AT, "label")


@query(f"""WITH {S.LABELS}, kept AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INTEGER) AS new FROM cell_px GROUP BY image_id, label HAVING count(*) BETWEEN 40 AND 90)
SELECT p.image_id, r AS "row", c AS "col", new AS label FROM cell_px p JOIN kept USING (image_id, label)""")
def filter_by_area(spark: SparkSession, d: str) -> DataFrame:
    return labeling.filter_by_area(_labels(spark, d), 40, 90).select(*AT, "label")


@query(f"WITH {S.LABELS} SELECT DISTINCT image_id, label AS old_cell_id FROM cell_px WHERE r IN (1, 64) OR c IN (1, 64)")
def edge_cells(spark: SparkSession, d: str) -> DataFrame:
    return masks.edge_cells(_labels(spark, d)).select("image_id", F.col("label").alias("old_cell_id"))


@query(f"""WITH {S.BOTH} SELECT image_id, r AS "row", c AS "col", CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS INTEGER) AS label FROM pred_px""")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    return labeling.relabel(_predicted(spark, d)).select(*AT, "label")


# neighbourhoods


@query(f"""WITH {S.EMB}, {S.stencil('emb', 'value', 1, 'sum')}
SELECT image_id, r AS "row", c AS "col", round(CASE WHEN r > 1 AND r < n_rows AND c > 1 AND c < 64 THEN x / 9 ELSE value END, 6) AS value FROM emb JOIN square USING (image_id, r, c)""")
def mean3(spark: SparkSession, d: str) -> DataFrame:
    return stencil.mean3(_raster(spark, d)).select(*AT, r6("value").alias("value"))


@query(f"""WITH {S.EMB}, {S.stencil('emb', 'value', 64, 'sum').replace('FOLLOWING', 'PRECEDING').replace('AND 64 PRECEDING', 'AND CURRENT ROW')}
SELECT image_id, r AS "row", c AS "col", round(x, 6) AS integral FROM square""")
def integral(spark: SparkSession, d: str) -> DataFrame:
    return stencil.integral(_raster(spark, d)).select(*AT, r6("integral").alias("integral"))


@query(f"""WITH {S.SCENE}, base AS (SELECT image_id, r, c, v / 1000.0 AS v FROM px WHERE ch = 1), {S.stencil('base', 'v', 25, 'sum')}
SELECT image_id, r AS "row", c AS "col", CAST(v - (x / 2601.0 - 0.05) > 1e-12 AS INTEGER) AS "on" FROM base JOIN square USING (image_id, r, c)""")
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    return stencil.adaptive(_pixels(spark, d)).select(*AT, "on")


def _morphology_sql(half: int, how: str) -> str:
    return f"""WITH {S.SCENE}, {_HOLED_SQL}, {S.stencil('holed', 'v', half, how)}
SELECT image_id, r AS "row", c AS "col", CAST(CASE WHEN r > {half} AND r <= 64 - {half} AND c > {half} AND c <= 64 - {half} THEN x ELSE 0 END AS INTEGER) AS "on" FROM square"""


@query(_morphology_sql(1, "min"))
def erode(spark: SparkSession, d: str) -> DataFrame:
    return stencil.erode(_dense(spark, d, _holed()), 3).select(*AT, "on")


@query(_morphology_sql(2, "max"))
def dilate(spark: SparkSession, d: str) -> DataFrame:
    return stencil.dilate(_dense(spark, d, _holed()), 5).select(*AT, "on")


_SOLID_SQL = "solid AS (SELECT image_id, r, c, CAST(label > 0 AS INTEGER) AS v FROM px WHERE ch = 1)"


@query(f"""WITH {S.SCENE}, {_SOLID_SQL}, {S.stencil('solid', 'v', 2, 'min')},
eroded AS (SELECT image_id, r, c, CASE WHEN r > 2 AND r <= 62 AND c > 2 AND c <= 62 THEN x ELSE 0 END AS v FROM square),
{S.stencil('eroded', 'v', 2, 'max').replace('along', 'along2').replace('square', 'square2')}
SELECT image_id, r AS "row", c AS "col", CAST(CASE WHEN r > 2 AND r <= 62 AND c > 2 AND c <= 62 THEN x ELSE 0 END AS INTEGER) AS "on" FROM square2""")
def opening(spark: SparkSession, d: str) -> DataFrame:
    return stencil.opening(_dense(spark, d, F.col("label") > 0), 5).select(*AT, "on")


@query(f'WITH {S.LABELS}, {S.BORDER} SELECT image_id, r AS "row", c AS "col", label, is_border FROM edge_px')
def border_pixels(spark: SparkSession, d: str) -> DataFrame:
    return stencil.border(_labels(spark, d)).select(*AT, "label", "is_border")


def _resample_sql(scale: float) -> str:
    return f"""WITH {S.EMB}, frames AS (SELECT image_id, any_value(n_rows) AS h, greatest(1, CAST(round_even(any_value(n_rows) * {scale}, 0) AS INTEGER)) AS nh, CAST(round_even(64 * {scale}, 0) AS INTEGER) AS nw FROM emb GROUP BY image_id),
t AS (SELECT image_id, h, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (i - 0.5) / {scale} + 0.5 AS sr, (j - 0.5) / {scale} + 0.5 AS sc FROM frames, range(1, 129) AS a(i), range(1, 129) AS b(j) WHERE i <= nh AND j <= nw),
k AS (SELECT *, greatest(1, CAST(floor(sr) AS INTEGER)) AS r0, greatest(1, CAST(floor(sc) AS INTEGER)) AS c0 FROM t)
SELECT k.image_id, i AS "row", j AS "col",
       round((1 - (sr - r0)) * (1 - (sc - c0)) * a.value + (sr - r0) * (1 - (sc - c0)) * b.value + (1 - (sr - r0)) * (sc - c0) * e.value + (sr - r0) * (sc - c0) * f.value, 6) AS value
FROM k JOIN emb a ON a.image_id = k.image_id AND a.r = r0 AND a.c = c0 JOIN emb b ON b.image_id = k.image_id AND b.r = least(h, r0 + 1) AND b.c = c0
JOIN emb e ON e.image_id = k.image_id AND e.r = r0 AND e.c = least(64, c0 + 1) JOIN emb f ON f.image_id = k.image_id AND f.r = least(h, r0 + 1) AND f.c = least(64, c0 + 1)"""


@query(_resample_sql(0.5))
def resample_half(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(_raster(spark, d), 0.5).select(*AT, r6("value").alias("value"))


@query(_resample_sql(2.0))
def resample_double(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(_raster(spark, d), 2.0).select(*AT, r6("value").alias("value"))


# intensities


@query(f"""WITH {S.SCENE}, lim AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px WHERE ch <= 2 GROUP BY image_id)
SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel, round((v - lo) / CAST(hi - lo AS DOUBLE), 6) AS value FROM px JOIN lim USING (image_id) WHERE ch <= 2""")
def contrast_stretch(spark: SparkSession, d: str) -> DataFrame:
    return intensity.contrast_stretch(_pixels(spark, d, 2)).select(*AT, "channel", r6("value").alias("value"))


@query(f"""WITH {S.SCENE}, lim AS (SELECT image_id, ch, min(v) AS lo, max(v) AS hi FROM px WHERE ch <= 2 GROUP BY ALL)
SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel, round((v - lo) / CAST(hi - lo AS DOUBLE), 6) AS value FROM px JOIN lim USING (image_id, ch)""")
def normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every channel stretched by its own range."""
    return intensity.normalize(_pixels(spark, d, 2)).select(*AT, "channel", r6("value").alias("value"))


@query(f"""WITH {S.SCENE}, m AS (SELECT image_id, ch, avg(v / 1000.0) AS mu, stddev_samp(v / 1000.0) AS sd FROM px WHERE ch <= 3 GROUP BY ALL)
SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel, round(least(greatest((v / 1000.0 - mu) / sd * 0.15 + 0.5, 0), 1), 6) AS value FROM px JOIN m USING (image_id, ch)""")
def reinhard(spark: SparkSession, d: str) -> DataFrame:
    return intensity.stain_normalize(_pixels(spark, d, 3), "macenko").select(*AT, "channel", r6("value").alias("value"))


@query(f"""WITH {S.SCENE}, lim AS (SELECT image_id, min(v / 1000.0) AS lo, max(v / 1000.0) AS hi FROM px WHERE ch = 1 GROUP BY image_id),
b AS (SELECT px.image_id, r, c, least(CAST(floor((v / 1000.0 - lo) / (hi - lo) * 256) AS INTEGER) + 1, 256) AS bin FROM px JOIN lim USING (image_id) WHERE ch = 1),
h AS (SELECT image_id, bin, CAST(sum(count(*)) OVER (PARTITION BY image_id ORDER BY bin) AS DOUBLE) AS cum FROM b GROUP BY image_id, bin),
z AS (SELECT image_id, bin, (cum - min(cum) OVER w) / (max(cum) OVER w - min(cum) OVER w) AS value FROM h WINDOW w AS (PARTITION BY image_id))
SELECT image_id, r AS "row", c AS "col", round(value, 6) AS value FROM b JOIN z USING (image_id, bin)""")
def equalize(spark: SparkSession, d: str) -> DataFrame:
    return intensity.equalize(_pixels(spark, d)).select(*AT, r6("value").alias("value"))


def _inverse() -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(intensity.RUIFROK)).tolist()


def _deconvolve_sql() -> str:
    m = _inverse()
    stains = " UNION ALL ".join(f"SELECT image_id, r, c, '{name}' AS stain, greatest(o1 * {m[0][j]!r} + o2 * {m[1][j]!r} + o3 * {m[2][j]!r}, 0) AS x FROM od" for j, name in enumerate(("hematoxylin", "eosin", "residual")))
    od = ", ".join(f"max(CASE WHEN ch = {k} THEN -ln(least(greatest(v / 1000.0, 1e-6), 1)) END) AS o{k}" for k in (1, 2, 3))
    return f'WITH {S.SCENE}, od AS (SELECT image_id, r, c, {od} FROM px GROUP BY ALL) SELECT image_id, r AS "row", c AS "col", stain, round(x, 6) AS value FROM ({stains})'


@query(_deconvolve_sql())
def deconvolve(spark: SparkSession, d: str) -> DataFrame:
    return intensity.deconvolve(_rasters(spark, d, 3), "ruifrok").select(*AT, "stain", r6("value").alias("value"))


def _axis_sql(out: str, matrix: str) -> str:
    """First main axis of the 3×3 matrices of ``matrix`` (``image_id, a .. f``: rows of the upper triangle) by repeated multiplication, pointing to a positive sum, and its variance."""
    x, y, z = "a * x + b * y + c * z", "b * x + d * y + e * z", "c * x + e * y + f * z"
    return f"""{out}_steps AS (SELECT image_id, 0 AS k, 5e-1 AS x, 6e-1 AS y, 7e-1 AS z FROM {matrix}
  UNION ALL SELECT image_id, k + 1, px / l, py / l, pz / l FROM (SELECT image_id, k, px, py, pz, sqrt(px * px + py * py + pz * pz) AS l FROM (SELECT image_id, k, {x} AS px, {y} AS py, {z} AS pz FROM {out}_steps JOIN {matrix} USING (image_id) WHERE k < 400))),
{out} AS MATERIALIZED (SELECT image_id, x * s AS x, y * s AS y, z * s AS z, x * ({x}) + y * ({y}) + z * ({z}) AS l FROM (SELECT *, CASE WHEN x + y + z < 0 THEN -1 ELSE 1 END AS s FROM {out}_steps WHERE k = 400) JOIN {matrix} USING (image_id))"""


_OD_SQL = ", ".join(f"max(CASE WHEN ch = {k} THEN -ln(least(greatest(v / 1000.0, 1e-6), 1)) END) AS o{k}" for k in (1, 2, 3))
_MACENKO_SQL = f"""{S.SCENE}, od AS MATERIALIZED (SELECT image_id, r, c, {_OD_SQL} FROM px GROUP BY ALL), stained AS (SELECT * FROM od WHERE sqrt(o1 * o1 + o2 * o2 + o3 * o3) > 0.15),
m1 AS MATERIALIZED (SELECT image_id, covar_samp(o1, o1) AS a, covar_samp(o1, o2) AS b, covar_samp(o1, o3) AS c, covar_samp(o2, o2) AS d, covar_samp(o2, o3) AS e, covar_samp(o3, o3) AS f FROM stained GROUP BY image_id HAVING count(*) >= 10),
{_axis_sql("first_", "m1")},
m2 AS MATERIALIZED (SELECT image_id, a - l * x * x AS a, b - l * x * y AS b, c - l * x * z AS c, d - l * y * y AS d, e - l * y * z AS e, f - l * z * z AS f FROM m1 JOIN first_ USING (image_id)),
{_axis_sql("second_", "m2")},
angles AS (SELECT image_id, quantile_cont(t, 0.01) AS low, quantile_cont(t, 0.99) AS high FROM (SELECT s.image_id, atan2(o1 * g.x + o2 * g.y + o3 * g.z, o1 * f.x + o2 * f.y + o3 * f.z) AS t FROM stained s JOIN first_ f USING (image_id) JOIN second_ g USING (image_id)) GROUP BY image_id),
two AS (SELECT image_id, f.x * cos(low) + g.x * sin(low) AS p1, f.y * cos(low) + g.y * sin(low) AS p2, f.z * cos(low) + g.z * sin(low) AS p3, f.x * cos(high) + g.x * sin(high) AS q1, f.y * cos(high) + g.y * sin(high) AS q2, f.z * cos(high) + g.z * sin(high) AS q3
  FROM angles JOIN first_ f USING (image_id) JOIN second_ g USING (image_id)),
three AS (SELECT *, p2 * q3 - p3 * q2 AS n1, p3 * q1 - p1 * q3 AS n2, p1 * q2 - p2 * q1 AS n3 FROM two),
own AS MATERIALIZED (SELECT image_id, p1, p2, p3, q1, q2, q3, n1 / l AS n1, n2 / l AS n2, n3 / l AS n3 FROM (SELECT *, sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS l FROM three))"""


@query(f"""WITH RECURSIVE {_MACENKO_SQL} SELECT image_id, CAST(k[1] AS INTEGER) AS channel, CAST(k[2] AS INTEGER) AS stain, round(k[3], 5) AS value
FROM (SELECT image_id, unnest([[1, 1, p1], [2, 1, p2], [3, 1, p3], [1, 2, q1], [2, 2, q2], [3, 2, q3], [1, 3, n1], [2, 3, n2], [3, 3, n3]]) AS k FROM own)""")
def macenko(spark: SparkSession, d: str) -> DataFrame:
    """The stain vectors of every image, stains as columns."""
    rows = intensity.macenko_stains(_pixels(spark, d, 3)).select("image_id", F.posexplode("stains").alias("channel", "v"))
    return rows.select("image_id", (F.col("channel") + 1).alias("channel"), F.posexplode("v").alias("stain", "value")).select("image_id", "channel", (F.col("stain") + 1).alias("stain"), F.round("value", 5).alias("value"))


@query(f"""WITH RECURSIVE {_MACENKO_SQL}, turned AS (SELECT *, p1 * (q2 * n3 - n2 * q3) - q1 * (p2 * n3 - n2 * p3) + n1 * (p2 * q3 - q2 * p3) AS det FROM own),
conc AS (SELECT image_id, r, c,
  (o1 * (q2 * n3 - n2 * q3) + o2 * (n2 * p3 - p2 * n3) + o3 * (p2 * q3 - q2 * p3)) / det AS hematoxylin,
  (o1 * (n1 * q3 - q1 * n3) + o2 * (p1 * n3 - n1 * p3) + o3 * (q1 * p3 - p1 * q3)) / det AS eosin,
  (o1 * (q1 * n2 - n1 * q2) + o2 * (n1 * p2 - p1 * n2) + o3 * (p1 * q2 - q1 * p2)) / det AS residual FROM od JOIN turned USING (image_id))
SELECT image_id, r AS "row", c AS "col", stain, round(greatest(x, 0), 4) AS value FROM (UNPIVOT conc ON hematoxylin, eosin, residual INTO NAME stain VALUE x)""")
def deconvolve_macenko(spark: SparkSession, d: str) -> DataFrame:
    return intensity.deconvolve(_rasters(spark, d, 3)).select(*AT, "stain", rounded("value", 4).alias("value"))


@query(f"WITH {S.SCENE}, {S.HISTOGRAM} SELECT image_id, bin, n, round(mid, 6) AS mid FROM hist")
def histogram256(spark: SparkSession, d: str) -> DataFrame:
    return intensity.histogram(_pixels(spark, d)).select("image_id", "bin", "n", r6("mid").alias("mid"))


@query(f"WITH {S.SCENE}, {S.HISTOGRAM}, {S.OTSU} SELECT image_id, round(threshold, 6) AS threshold FROM otsu")
def otsu(spark: SparkSession, d: str) -> DataFrame:
    return intensity.otsu(_pixels(spark, d)).select("image_id", r6("threshold").alias("threshold"))


@query(f"""WITH {S.SCENE}, {S.HISTOGRAM},
peak AS (SELECT image_id, arg_min(bin, bin - n * 1000) AS p, any_value(lo) AS lo, any_value(w) AS w FROM hist GROUP BY image_id),
far AS (SELECT *, CASE WHEN p <= 128 THEN 256 ELSE 1 END AS e FROM peak),
full_ AS (SELECT far.*, CAST(b AS INTEGER) AS b, coalesce(h.n, 0) AS n, g.n AS y1, coalesce(k.n, 0) AS y2 FROM far CROSS JOIN range(1, 257) AS x(b)
  LEFT JOIN hist h ON h.image_id = far.image_id AND h.bin = b JOIN hist g ON g.image_id = far.image_id AND g.bin = p LEFT JOIN hist k ON k.image_id = far.image_id AND k.bin = e),
d AS (SELECT image_id, b, lo + (b - 0.5) * w AS mid, abs((y2 - y1) * (lo + (b - 0.5) * w) - (e - p) * w * n + (lo + (e - 0.5) * w) * y1 - y2 * (lo + (p - 0.5) * w)) / sqrt(((e - p) * w) * ((e - p) * w) + (y2 - y1) * (y2 - y1)) AS dist
  FROM full_ WHERE b BETWEEN least(p, e) AND greatest(p, e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(dist, 9) DESC, b) AS k FROM d)
SELECT image_id, round(mid, 6) AS threshold FROM ranked WHERE k = 1""")
def triangle(spark: SparkSession, d: str) -> DataFrame:
    return intensity.triangle(_pixels(spark, d)).select("image_id", r6("threshold").alias("threshold"))


@query(f'WITH {S.SCENE}, {S.HISTOGRAM}, {S.OTSU} SELECT px.image_id, r AS "row", c AS "col", CAST(v / 1000.0 > threshold AS INTEGER) AS "on" FROM px JOIN otsu USING (image_id) WHERE ch = 1')
def binarize(spark: SparkSession, d: str) -> DataFrame:
    return segment.binarize(_pixels(spark, d)).select(*AT, "on")


_PREPARED_SQL = """m AS (SELECT image_id, ch, avg(v / 1000.0) AS mu, stddev_samp(v / 1000.0) AS sd FROM px WHERE ch <= 3 GROUP BY ALL),
p AS MATERIALIZED (SELECT image_id, r, c, ch, least(greatest((v / 1000.0 - mu) / sd * 0.15 + 0.5, 0), 1) AS v FROM px JOIN m USING (image_id, ch)),
a1 AS (SELECT *, sum(v) OVER (PARTITION BY image_id, ch, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM p),
a2 AS (SELECT *, sum(x) OVER (PARTITION BY image_id, ch, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM a1),
smooth AS (SELECT image_id, r, c, ch, CASE WHEN r BETWEEN 2 AND 63 AND c BETWEEN 2 AND 63 THEN y / 9 ELSE v END AS v FROM a2),
lim AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM smooth GROUP BY image_id),
flat AS MATERIALIZED (SELECT image_id, r, c, ch, (v - lo) / (hi - lo) AS v FROM smooth JOIN lim USING (image_id))"""


def _shrunk_sql(source: str, scale: str) -> str:
    """``source`` (``image_id, r, c, ch, v`` of 64 by 64) resampled by ``scale``, an expression of ``image_id``."""
    return f"""sizes AS (SELECT DISTINCT image_id, {scale} AS s FROM {source}), k AS (SELECT image_id, s, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (i - 0.5) / s + 0.5 AS sr, (j - 0.5) / s + 0.5 AS sc FROM sizes, range(1, 129) AS a(i), range(1, 129) AS b(j)
  WHERE i <= round_even(64 * s, 0) AND j <= round_even(64 * s, 0)),
corner AS (SELECT *, greatest(1, CAST(floor(sr) AS INTEGER)) AS r0, greatest(1, CAST(floor(sc) AS INTEGER)) AS c0 FROM k),
four AS (SELECT image_id, i, j, r0 + dr AS rr, c0 + dc AS cc, (CASE dr WHEN 0 THEN 1 - (sr - r0) ELSE sr - r0 END) * (CASE dc WHEN 0 THEN 1 - (sc - c0) ELSE sc - c0 END) AS w FROM corner, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(dr, dc)),
small AS (SELECT f.image_id, i, j, ch, sum(w * x.v) AS v FROM four f JOIN {source} x ON x.image_id = f.image_id AND x.r = least(64, rr) AND x.c = least(64, cc) GROUP BY ALL)"""


@query(f"""WITH {S.SCENE}, {_PREPARED_SQL}, {_shrunk_sql("flat", "0.5")} SELECT image_id, i AS "row", j AS "col", CAST(ch AS INTEGER) AS channel, round(v, 6) AS value FROM small""")
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    return intensity.preprocess(_rasters(spark, d, 3), stain="reinhard", denoise=True, contrast="stretch", scale=0.5).select(*AT, "channel", rounded("value", 6).alias("value"))


def _resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Pixel sizes of the scene's images: 0.25, 0.5 or 1 µm, or none."""
    width = F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0), F.lit(None).cast("double")), (F.col("image_id") % 4 + 1).cast("int"))
    return _images(spark, d).withColumns({"resolution": F.struct(width.alias("x_um"), width.alias("y_um")), "history": F.array(F.lit("scanned"))})


_SCALE_SQL = "CASE image_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 1.0 END"


@query(f"""WITH {S.SCENE}, flat AS MATERIALIZED (SELECT image_id, r, c, ch, v / 1000.0 AS v FROM px WHERE ch <= 2), {_shrunk_sql("flat", _SCALE_SQL)} SELECT image_id, i AS "row", j AS "col", CAST(ch AS INTEGER) AS channel, round(v, 10) AS value FROM small""")
def preprocess_resolution(spark: SparkSession, d: str) -> DataFrame:
    px = intensity.preprocess(_rasters(spark, d, 2), target_resolution=0.5, images=_resolutions(spark, d))
    # sixteenths of thousandths are ties at six places
    return px.select(*AT, "channel", rounded("value", 10).alias("value"))


@query(f"""WITH {S.CELLS}, {S.IMAGES} SELECT image_id, CAST(64 * {_SCALE_SQL} AS INTEGER) AS n_rows, CASE WHEN image_id % 4 < 3 THEN 0.5 END AS x_um, CASE WHEN image_id % 4 < 3 THEN 'scanned -> denoise:mean3x3 -> resample:0.5um' ELSE 'scanned -> denoise:mean3x3' END AS history FROM imgs""")
def preprocessed_images(spark: SparkSession, d: str) -> DataFrame:
    images = intensity.preprocessed(_resolutions(spark, d), denoise=True, target_resolution=0.5)
    return images.select("image_id", "n_rows", F.col("resolution.x_um").alias("x_um"), F.array_join("history", " -> ").alias("history"))


# labelling and growth


@query(f"""WITH RECURSIVE {S.LABELS},
lone AS (SELECT image_id, r, c, c - row_number() OVER (PARTITION BY image_id, r ORDER BY c) AS i FROM cell_px),
runs AS (SELECT image_id, r, min(c) AS a, max(c) AS b, (r - 1) * 64 + min(c) - 1 AS node FROM lone GROUP BY image_id, r, i),
near AS (SELECT x.image_id, x.node AS u, y.node AS v FROM runs x JOIN runs y ON x.image_id = y.image_id AND abs(x.r - y.r) = 1 AND x.a <= y.b AND x.b >= y.a),
reach AS (SELECT image_id, node, node AS root FROM runs UNION SELECT n.image_id, n.v, reach.root FROM reach JOIN near n ON n.image_id = reach.image_id AND n.u = reach.node WHERE reach.root < n.v),
roots AS (SELECT image_id, node, min(root) AS root FROM reach GROUP BY image_id, node),
named AS (SELECT image_id, node, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM roots)
SELECT runs.image_id, CAST(runs.r AS INTEGER) AS "row", p.c AS "col", named.label FROM runs JOIN named USING (image_id, node) JOIN cell_px p ON p.image_id = runs.image_id AND p.r = runs.r AND p.c BETWEEN a AND b""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return labeling.components(_labels(spark, d)).select(*AT, "label")


@query(f"""WITH RECURSIVE {S.SCENE}, {_HOLED_SQL}, off AS (SELECT image_id, r, c FROM holed WHERE v = 0),
outside AS (SELECT image_id, r, c FROM off WHERE r IN (1, 64) OR c IN (1, 64)
  UNION SELECT o.image_id, o.r, o.c FROM (SELECT image_id, r + dr AS r, c + dc AS c FROM outside, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)) s JOIN off o USING (image_id, r, c))
SELECT image_id, r AS "row", c AS "col" FROM holed ANTI JOIN outside USING (image_id, r, c)""")
def fill_holes(spark: SparkSession, d: str) -> DataFrame:
    return labeling.fill_holes(_dense(spark, d, _holed())).select(*AT)


@query(f"""WITH {S.SCENE}, {_SOLID_SQL},
v AS (SELECT image_id, r, c, least(r - max(CASE WHEN v = 1 THEN r END) OVER (PARTITION BY image_id, c ORDER BY r), min(CASE WHEN v = 1 THEN r END) OVER (PARTITION BY image_id, c ORDER BY r DESC) - r) AS up FROM solid)
SELECT a.image_id, a.r AS "row", a.c AS "col", CAST(min(b.up + abs(a.c - b.c)) AS INTEGER) AS d FROM v a JOIN v b ON a.image_id = b.image_id AND a.r = b.r GROUP BY ALL""")
def distance_l1(spark: SparkSession, d: str) -> DataFrame:
    return labeling.distance(_dense(spark, d, F.col("label") > 0)).select(*AT, F.col("d").cast("int").alias("d"))


def _grow_sql(steps: int) -> str:
    parts, last = [S.LABELS, "g0 AS (SELECT image_id, r, c, label FROM cell_px)"], "g0"
    for k in range(1, steps + 1):
        parts.append(f"""n{k} AS (SELECT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c, label, count(*) AS n FROM {last}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)
  WHERE r + dr BETWEEN 1 AND 64 AND c + dc BETWEEN 1 AND 64 GROUP BY ALL),
b{k} AS (SELECT image_id, r, c, label, row_number() OVER (PARTITION BY image_id, r, c ORDER BY n DESC, label) AS k FROM n{k} ANTI JOIN {last} USING (image_id, r, c)),
g{k} AS (SELECT * FROM {last} UNION ALL SELECT image_id, r, c, label FROM b{k} WHERE k = 1)""")
        last = f"g{k}"
    return f'WITH {", ".join(parts)} SELECT image_id, r AS "row", c AS "col", label FROM {last}'


@query(_grow_sql(3))
def grow_3(spark: SparkSession, d: str) -> DataFrame:
    return labeling.grow(_labels(spark, d), 3).select(*AT, "label")


@query(f"""WITH RECURSIVE {S.SCENE}, {_SOLID_SQL}, {S.seeds("solid", "found", 0.9)} SELECT image_id, r AS "row", c AS "col", label FROM found""")
def seeds(spark: SparkSession, d: str) -> DataFrame:
    return labeling.seeds(_dense(spark, d, F.col("label") > 0), 0.9).select(*AT, "label")


_OTSU_SQL = f"{S.SCENE}, {S.HISTOGRAM}, {S.OTSU}, bright AS MATERIALIZED (SELECT px.image_id, r, c, CAST(v / 1000.0 > threshold AS INTEGER) AS v FROM px JOIN otsu USING (image_id) WHERE ch = 1)"


@query(f"""WITH RECURSIVE {_OTSU_SQL}, {S.opened("bright", "opened")}, {S.filled("opened", "full_")}, {S.components("full_", "parts")},
kept AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INTEGER) AS new FROM parts GROUP BY image_id, label HAVING count(*) BETWEEN 20 AND 5000)
SELECT p.image_id, r AS "row", c AS "col", new AS label FROM parts p JOIN kept USING (image_id, label)""")
def threshold_mask(spark: SparkSession, d: str) -> DataFrame:
    return segment.threshold(_pixels(spark, d), min_area=20).select(*AT, "label")


@query(f"""WITH RECURSIVE {_OTSU_SQL}, {S.seeds("bright", "found", 0.95)}, {S.grown("found", "spread", 64 + 3)} SELECT image_id, r AS "row", c AS "col", label FROM spread""")
def watershed_mask(spark: SparkSession, d: str) -> DataFrame:
    return segment.watershed(_pixels(spark, d), h=0.95).select(*AT, "label")


@query(f"""WITH RECURSIVE {S.SCENE}, {S.PRED_PX}, limits AS (SELECT image_id, quantile_cont(v / 1000.0, 0.9) AS q FROM px WHERE ch = 1 GROUP BY image_id),
dark AS MATERIALIZED (SELECT px.image_id, r, c FROM px JOIN limits USING (image_id) WHERE ch = 1 AND v / 1000.0 < q), {S.grown("pred_px", "spread", 5, "dark")}
SELECT image_id, r AS "row", c AS "col", label FROM spread""")
def propagated(spark: SparkSession, d: str) -> DataFrame:
    return segment.propagate(_predicted(spark, d), _pixels(spark, d), expand_max=5).select(*AT, "label")


# measurements


@query(f"WITH {S.LABELS} SELECT image_id, label AS cell_id, count(*) AS area FROM cell_px GROUP BY ALL")
def cell_area(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).groupBy("image_id", F.col("label").alias("cell_id")).agg(F.count("*").alias("area"))


@query(f"WITH {S.LABELS} SELECT image_id, count(*) AS n, min(area) AS min_area, quantile_cont(area, 0.5) AS median_area, max(area) AS max_area FROM (SELECT image_id, label, count(*) AS area FROM cell_px GROUP BY ALL) GROUP BY image_id")
def area_summary(spark: SparkSession, d: str) -> DataFrame:
    return measure.area_summary(_labels(spark, d))


_IDS_SQL = "ids AS (SELECT image_id, CAST(unnest(range(1, max(label) + 1)) AS INTEGER) AS label FROM cell_px GROUP BY image_id)"


@query(f"WITH {S.LABELS}, {_IDS_SQL} SELECT image_id, label AS cell_id, round(avg(r), 6) AS centroid_row, round(avg(c), 6) AS centroid_col FROM ids LEFT JOIN cell_px USING (image_id, label) GROUP BY ALL")
def cell_location(spark: SparkSession, d: str) -> DataFrame:
    f = measure.extract_features(_pixels(spark, d), _labels(spark, d), ["DAPI"], ("location",))
    return f.select("image_id", "cell_id", r6("centroid_row").alias("centroid_row"), r6("centroid_col").alias("centroid_col"))


def _intensity_sql() -> str:
    stats = []
    for k, name in ((1, "DAPI"), (3, "CD8")):
        x = f"CASE WHEN ch = {k} THEN v / 1000.0 END"
        for out, f in (("mean", f"avg({x})"), ("sd", f"stddev_samp({x})"), ("median", f"quantile_cont({x}, 0.5)"), ("min", f"min({x})"), ("max", f"max({x})"), ("q25", f"quantile_cont({x}, 0.25)"), ("q75", f"quantile_cont({x}, 0.75)")):
            stats.append(f'round({f}, {10 if out == "mean" else 6}) AS "{name}_{out}"')
    return f"WITH {S.SCENE} SELECT image_id, label AS cell_id, {', '.join(stats)} FROM px WHERE label > 0 GROUP BY ALL"


@query(_intensity_sql())
def cell_intensity(spark: SparkSession, d: str) -> DataFrame:
    f = measure.extract_features(_pixels(spark, d, 4), _labels(spark, d), ["DAPI", "CD3", "CD8", "PanCK"], ("intensity",), ["DAPI", 3])
    # means of up to 154 thousandths are ties at six places, but not at ten
    return f.select("image_id", "cell_id", *[F.round(c, 10 if c.endswith("_mean") else 6).alias(c) for c in f.columns[2:]])


@query(f"""WITH {S.SCENE}, q AS (SELECT image_id, label, v / 1000.0 AS x, v // 10 + CASE WHEN v % 10 > 5 THEN 1 WHEN v % 10 = 5 THEN (v // 10) % 2 ELSE 0 END AS b FROM px WHERE ch = 1 AND label > 0),
n AS (SELECT image_id, label, b, count(*) AS n FROM q GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY image_id, label) AS DOUBLE) AS p FROM n),
e AS (SELECT image_id, label, -sum(p * log2(p)) AS e FROM p GROUP BY ALL), i AS (SELECT image_id, label, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS i FROM q GROUP BY ALL)
SELECT image_id, label AS cell_id, round(abs(e), 6) AS "DAPI_entropy", round(i, 6) AS "DAPI_iqr" FROM e JOIN i USING (image_id, label)""")
def cell_texture(spark: SparkSession, d: str) -> DataFrame:
    f = measure.extract_features(_pixels(spark, d), _labels(spark, d), ["DAPI"], ("texture",))
    return f.select("image_id", "cell_id", r6("DAPI_entropy").alias("DAPI_entropy"), r6("DAPI_iqr").alias("DAPI_iqr"))


@query(f"""WITH {S.SHAPES}, {S.HULL} SELECT image_id, label AS cell_id, area, perimeter, round(circularity, 6) AS circularity, round(eccentricity, 6) AS eccentricity,
  round(CASE WHEN hull_area > 0 THEN area / hull_area END, 6) AS solidity FROM cell_shape JOIN hulls USING (image_id, label)""")
def cell_morphology(spark: SparkSession, d: str) -> DataFrame:
    f = measure.extract_features(_pixels(spark, d), _labels(spark, d), ["DAPI"], ("morphology",))
    return f.select("image_id", "cell_id", "area", "perimeter", *[r6(c).alias(c) for c in ("circularity", "eccentricity", "solidity")])


@query(f"WITH {S.LABELS} SELECT image_id, label AS cell_id, min(r) AS bbox_row_min, max(r) AS bbox_row_max, min(c) AS bbox_col_min, max(c) AS bbox_col_max FROM cell_px GROUP BY ALL")
def cell_bbox(spark: SparkSession, d: str) -> DataFrame:
    return measure.moments(_labels(spark, d)).select("image_id", F.col("label").alias("cell_id"), "bbox_row_min", "bbox_row_max", "bbox_col_min", "bbox_col_max")


@query(f"WITH {S.LABELS}, {S.HULL} SELECT image_id, label AS cell_id, round(hull_area, 6) AS hull_area FROM hulls")
def hull_area(spark: SparkSession, d: str) -> DataFrame:
    return measure.hulls(_labels(spark, d)).select("image_id", F.col("label").alias("cell_id"), r6("hull_area").alias("hull_area"))


@query(f'WITH {S.LABELS}, {S.HULL}, big AS (SELECT image_id, label FROM hulls WHERE hull_area > 0) SELECT DISTINCT image_id, label AS cell_id, CAST(r AS DOUBLE) AS "row", CAST(c AS DOUBLE) AS "col" FROM vertices SEMI JOIN big USING (image_id, label)')
def polygon_vertices(spark: SparkSession, d: str) -> DataFrame:
    points = measure.outline_points(measure.polygons(_labels(spark, d)))
    return points.select("image_id", F.col("label").alias("cell_id"), "row", "col").distinct()


# merging and correcting


@query(f"""WITH {S.BOTH}, n AS (SELECT image_id, p.label AS nucleus, g.label AS cell, count(*) AS n FROM pred_px p JOIN cell_px g USING (image_id, r, c) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, nucleus ORDER BY n DESC, cell) AS k FROM n)
SELECT p.image_id, r AS "row", c AS "col", cell AS label FROM pred_px p JOIN b ON b.image_id = p.image_id AND b.nucleus = p.label AND k = 1""")
def merge_assign(spark: SparkSession, d: str) -> DataFrame:
    return masks.merge_assign(_predicted(spark, d), _labels(spark, d)).select(*AT, "label")


@query(f"""WITH RECURSIVE {S.BOTH}, {S.grown("pred_px", "spread", 64, "cell_px")} SELECT image_id, r AS "row", c AS "col", label FROM spread""")
def merge_expand(spark: SparkSession, d: str) -> DataFrame:
    return masks.merge_expand(_predicted(spark, d), _labels(spark, d)).select(*AT, "label")


def _corrections(images: DataFrame, actions: list[str]) -> DataFrame:
    """The same list of corrections for each image."""
    given = {
        "delete": ("delete", 3, None, None),
        "merge": ("merge", None, [1, 2], None),
        "merge3": ("merge", None, [5, 6, 7], None),
        "add": ("add", None, None, [(1, 1), (1, 2), (2, 1), (70, 3)]),
        "split": ("split", 4, None, [(20, 20), (40, 40)]),
    }
    names = ("seq", "action", "cell_id", "cell_ids", "points")
    rows = [dict(zip(names, (i + 1, *given[a][:3], given[a][3] and [{"row": r, "col": c} for r, c in given[a][3]]))) for i, a in enumerate(actions)]
    kind = "array<struct<seq: int, action: string, cell_id: int, cell_ids: array<int>, points: array<struct<row: int, col: int>>>>"
    return images.select("image_id", F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


@query(f"""WITH {S.LABELS}, m AS (SELECT image_id, r, c, CASE label WHEN 2 THEN 1 WHEN 6 THEN 5 WHEN 7 THEN 5 ELSE label END AS label FROM cell_px WHERE label <> 3)
SELECT image_id, r AS "row", c AS "col", CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS INTEGER) AS label FROM m""")
def corrections_delete_merge(spark: SparkSession, d: str) -> DataFrame:
    return masks.apply_corrections(_labels(spark, d), _corrections(_images(spark, d), ["delete", "merge", "merge3"])).select(*AT, "label")


@query(f"""WITH {S.LABELS}, {S.IMAGES}, spots AS (SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM imgs, (VALUES (1, 1), (1, 2), (2, 1)) AS t(r, c)),
m AS (SELECT image_id, r, c, label FROM cell_px ANTI JOIN spots USING (image_id, r, c) UNION ALL SELECT image_id, r, c, 1000 FROM spots)
SELECT image_id, r AS "row", c AS "col", CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS INTEGER) AS label FROM m""")
def corrections_add(spark: SparkSession, d: str) -> DataFrame:
    return masks.apply_corrections(_labels(spark, d), _corrections(_images(spark, d), ["add"])).select(*AT, "label")


@query(f"""WITH RECURSIVE {S.LABELS}, {S.IMAGES}, kept AS (SELECT * FROM cell_px WHERE label <> 3), top AS (SELECT image_id, max(label) AS top FROM kept GROUP BY image_id),
marks AS (SELECT image_id, r, c, CAST(top + s AS INTEGER) AS label FROM imgs JOIN top USING (image_id), (VALUES (20, 20, 1), (40, 40, 2)) AS t(r, c, s)),
within AS (SELECT image_id, r, c FROM kept WHERE label = 4), {S.grown("marks", "painted", 64, "within")},
m AS (SELECT image_id, r, c, label FROM (SELECT * FROM kept WHERE label <> 4) ANTI JOIN painted USING (image_id, r, c) UNION ALL SELECT image_id, r, c, label FROM painted)
SELECT image_id, r AS "row", c AS "col", CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY CASE label WHEN 2 THEN 1 ELSE label END) AS INTEGER) AS label FROM m""")
def corrections_split(spark: SparkSession, d: str) -> DataFrame:
    return masks.apply_corrections(_labels(spark, d), _corrections(_images(spark, d), ["delete", "split", "merge"])).select(*AT, "label")


# evaluation


@query(f"WITH {S.BOTH}, {S.OVERLAPS} SELECT image_id, pred, gt, inter, round(iou, 6) AS iou FROM iou")
def overlap_iou(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overlaps(_predicted(spark, d), _labels(spark, d)).select("image_id", "pred", "gt", "inter", r6("iou").alias("iou"))


@query(f"""WITH {S.BOTH}, {S.IMAGES}, {S.OVERLAPS},
p AS (SELECT image_id, count(*) AS ppx, max(label) AS pn FROM pred_px GROUP BY ALL), g AS (SELECT image_id, count(*) AS gpx, max(label) AS gn FROM cell_px GROUP BY ALL),
both_ AS (SELECT image_id, CAST(sum(inter) AS DOUBLE) AS both_ FROM pairs GROUP BY ALL),
bg AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt ORDER BY iou DESC, pred) AS k FROM iou),
best AS (SELECT * FROM bg WHERE k = 1),
aji AS (SELECT image_id, sum(inter) AS i, sum(pred_area + gt_area - inter) AS u FROM best GROUP BY ALL),
lost AS (SELECT image_id, sum(gt_area) AS lost FROM ga ANTI JOIN best USING (image_id, gt) GROUP BY ALL),
idle AS (SELECT image_id, sum(pred_area) AS idle FROM pa ANTI JOIN best USING (image_id, pred) GROUP BY ALL),
pq AS (SELECT image_id, count(*) AS tp, sum(iou) AS s FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pred ORDER BY gt) AS j FROM best WHERE iou > 0.5) WHERE j = 1 GROUP BY ALL),
bp AS (SELECT *, row_number() OVER (PARTITION BY image_id, pred ORDER BY iou DESC, gt) AS k FROM iou),
ap AS (SELECT image_id, count(DISTINCT CASE WHEN iou >= 0.5 THEN gt END) AS t50, count(DISTINCT CASE WHEN iou >= 0.75 THEN gt END) AS t75 FROM bp WHERE k = 1 GROUP BY ALL),
v AS (SELECT image_id, 2 * both_ / (ppx + gpx) AS dice, both_ / (ppx + gpx - both_) AS jaccard, i / CAST(u + coalesce(lost, 0) + coalesce(idle, 0) AS DOUBLE) AS aji,
  coalesce(s / (tp + 0.5 * (pn - tp) + 0.5 * (gn - tp)), 0) AS panoptic_quality, 2.0 * t50 / (pn + gn) AS ap50, 2.0 * t75 / (pn + gn) AS ap75, 2.0 * t50 / (pn + gn) AS f1_detection
  FROM imgs JOIN p USING (image_id) JOIN g USING (image_id) JOIN both_ USING (image_id) JOIN aji USING (image_id) LEFT JOIN lost USING (image_id) LEFT JOIN idle USING (image_id) LEFT JOIN pq USING (image_id) JOIN ap USING (image_id))
SELECT image_id, metric, round(value, 6) AS value FROM (UNPIVOT v ON dice, jaccard, aji, panoptic_quality, ap50, ap75, f1_detection INTO NAME metric VALUE value)""")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.evaluate(_predicted(spark, d), _labels(spark, d), _images(spark, d))
    return e.select("image_id", "metric", r6("value").alias("value"))


# annotation


_PATCHES_SQL = """pt AS (SELECT image_id, CAST((j * 4 + i + 1) AS INTEGER) AS patch_id, CAST(round_even(1 + i * 48 / 3.0, 0) AS INTEGER) AS row_start, CAST(round_even(1 + j * 48 / 2.0, 0) AS INTEGER) AS col_start
  FROM imgs, range(0, 4) AS a(i), range(0, 3) AS b(j) WHERE j * 4 + i + 1 <= 10)"""


@query(f"WITH {S.CELLS}, {S.IMAGES}, {_PATCHES_SQL} SELECT image_id, patch_id, row_start, CAST(row_start + 15 AS INTEGER) AS row_end, col_start, CAST(col_start + 15 AS INTEGER) AS col_end FROM pt")
def patch_grid(spark: SparkSession, d: str) -> DataFrame:
    return annotate.patch_grid(_images(spark, d), 10, 16)


@query(f"""WITH {S.LABELS}, {S.IMAGES}, {S.BORDER}, {_PATCHES_SQL},
sc AS (SELECT pt.image_id, patch_id, coalesce(avg(CASE WHEN p.label IS NOT NULL THEN CAST(inner_border AS DOUBLE) END), 0) AS score
  FROM pt LEFT JOIN (SELECT e.*, EXISTS (SELECT 1 FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc) WHERE NOT EXISTS (SELECT 1 FROM cell_px q WHERE q.image_id = e.image_id AND q.r = e.r + dr AND q.c = e.c + dc AND q.label = e.label)) AS inner_border FROM edge_px e) p
  ON p.image_id = pt.image_id AND p.r > row_start AND p.r < row_start + 15 AND p.c > col_start AND p.c < col_start + 15 GROUP BY ALL)
SELECT image_id, patch_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, patch_id) AS INTEGER) AS rank FROM sc""")
def patch_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    task = annotate.annotation_task(_images(spark, d), _labels(spark, d), n_patches=10, patch_size=16)
    return task.select("image_id", "patch_id", r6("score").alias("score"), "rank")


@query()
def patch_random(spark: SparkSession, d: str) -> DataFrame:
    return annotate.patch_random(_images(spark, d), 10, 16)


@query(f"""WITH {S.SCENE}, {_PATCHES_SQL} SELECT px.image_id, patch_id, CAST(r - row_start + 1 AS INTEGER) AS "row", CAST(c - col_start + 1 AS INTEGER) AS "col", CAST(ch AS INTEGER) AS channel, round(v / 1000.0, 6) AS value, label FROM px JOIN pt ON pt.image_id = px.image_id AND r BETWEEN row_start AND row_start + 15 AND c BETWEEN col_start AND col_start + 15 WHERE ch = 1""")
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = annotate.training_pairs(_pixels(spark, d), _labels(spark, d), annotate.patch_grid(_images(spark, d), 10, 16), 16)
    return pairs.withColumn("value", r6("value"))


@query(f"WITH {S.CELLS}, {S.IMAGES}, {_PATCHES_SQL} SELECT CAST(n AS INTEGER) AS round, 'cellpose' AS model, image_id, patch_id FROM pt, range(1, 4) AS t(n)")
def active_rounds(spark: SparkSession, d: str) -> DataFrame:
    return annotate.active_rounds(annotate.annotation_task(_images(spark, d), n_patches=10, patch_size=16), 3).select("round", "model", "image_id", "patch_id")


# sinks, plots, models


@query(f"""WITH {S.SHAPES}, {S.HULL} SELECT image_id, area, perimeter, round(circularity, 6) AS circularity, round(eccentricity, 6) AS eccentricity, round(CASE WHEN hull_area > 0 THEN area / hull_area END, 6) AS solidity,
  round(sr / n, 6) AS centroid_row, round(sc / n, 6) AS centroid_col, r0 AS bbox_row_min, r1 AS bbox_row_max, c0 AS bbox_col_min, c1 AS bbox_col_max, label AS cell_id FROM cell_shape JOIN hulls USING (image_id, label)""")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = files.cell_csv(_labels(spark, d))
    return rows.select(*[r6(c).alias(c) if c in ("circularity", "eccentricity", "solidity", "centroid_row", "centroid_col") else c for c in rows.columns])


_RINGS_SQL = """points AS (SELECT DISTINCT image_id, label, r, c FROM vertices), middles AS (SELECT image_id, label, avg(r) AS mr, avg(c) AS mc FROM points GROUP BY ALL),
turned AS (SELECT p.*, atan2(r - mr, c - mc) AS turn, first_value(atan2(r - mr, c - mc)) OVER (PARTITION BY image_id, label ORDER BY c, r) AS start FROM points p JOIN middles USING (image_id, label) JOIN hulls USING (image_id, label) WHERE hull_area > 0 AND n >= 3),
rings AS (SELECT image_id, label, string_agg(printf('[%.1f,%.1f]', CAST(c AS DOUBLE), CAST(r AS DOUBLE)), ',' ORDER BY CASE WHEN turn >= start - 1e-9 THEN 0 ELSE 1 END, turn) AS ring, first(printf('[%.1f,%.1f]', CAST(c AS DOUBLE), CAST(r AS DOUBLE)) ORDER BY c, r) AS again FROM turned GROUP BY ALL)"""


@query(f"""WITH {S.LABELS}, {S.HULL.replace("SELECT image_id, label, CASE WHEN n < 3", "SELECT image_id, label, n, CASE WHEN n < 3")}, {_RINGS_SQL}
SELECT image_id, label AS cell_id, '{{"type":"Feature","id":"cell-' || label || '","geometry":{{"type":"Polygon","coordinates":[[' || ring || ',' || again || ']]}},"properties":{{"objectType":"detection","classification":{{"name":"Cell"}},"cellID":' || label || '}}}}' AS feature FROM rings""")
def export_qupath(spark: SparkSession, d: str) -> DataFrame:
    return files.geojson_features(_labels(spark, d), qupath=True)


@query(f"""WITH {S.LABELS}, {S.HULL.replace("SELECT image_id, label, CASE WHEN n < 3", "SELECT image_id, label, n, CASE WHEN n < 3")}, {_RINGS_SQL}
SELECT image_id, label AS cell_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || ring || ',' || again || ']]}},"properties":{{"cell_id":' || label || '}}}}' AS feature FROM rings""")
def export_geojson(spark: SparkSession, d: str) -> DataFrame:
    return files.geojson_features(_labels(spark, d))


@query()
def export_simplified(spark: SparkSession, d: str) -> DataFrame:
    return files.geojson_features(_labels(spark, d), simplify=True)


def _read_back(rasters: DataFrame) -> DataFrame:
    """Pixels of raster files, whole numbers of their depth."""
    import pandas as pd

    def of(frames):
        for f in frames:
            for image, content in zip(f["image_id"], f["content"]):
                a = rasterfiles.decode(bytes(content))
                r, c, k = (x.ravel() for x in np.indices(a.shape))
                yield pd.DataFrame({"image_id": image, "row": r + 1, "col": c + 1, "channel": k + 1, "value": a.ravel()})

    return rasters.mapInPandas(of, "image_id bigint, row int, col int, channel int, value double")


_RAINBOW_SQL = """tone AS (SELECT p.*, 6.0 * (coalesce(label, 0) - 1) / most AS h FROM px p JOIN (SELECT image_id, max(label) AS most FROM cell_px GROUP BY ALL) USING (image_id) WHERE ch <= 3)"""


@query(f"""WITH {S.SCENE}, {_RAINBOW_SQL} SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel,
  CAST(CASE WHEN label = 0 THEN 0 ELSE round_even(255 * greatest(0.0, least(1.0, CASE ch WHEN 1 THEN abs(h - 3) - 1 WHEN 2 THEN 2 - abs(h - 2) ELSE 2 - abs(h - 4) END)), 0) END AS INTEGER) AS value FROM tone""")
def export_png(spark: SparkSession, d: str) -> DataFrame:
    """Masks as PNG files, read again."""
    back = _read_back(files.mask_rasters(_labels(spark, d), "png"))
    return back.withColumn("value", F.round(F.col("value") * 255).cast("int"))


@query(f"""WITH {S.SCENE} SELECT p.image_id, r AS "row", c AS "col", CAST(round_even(label / CAST(most AS DOUBLE) * 65535, 0) AS INTEGER) AS value FROM px p JOIN (SELECT image_id, max(label) AS most FROM cell_px GROUP BY ALL) USING (image_id) WHERE ch = 1""")
def export_tiff(spark: SparkSession, d: str) -> DataFrame:
    """Masks as TIFF files, read again."""
    back = _read_back(files.mask_rasters(_labels(spark, d), "tiff"))
    return back.select(*AT, F.round(F.col("value") * 65535).cast("int").alias("value"))


@query(f'WITH {S.LABELS}, {S.BORDER} SELECT image_id, r AS "row", c AS "col", label FROM edge_px WHERE is_border')
def plot_outlines(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.outlines(_labels(spark, d))


@query(f'WITH {S.LABELS} SELECT image_id, label, round(avg(r), 6) AS "row", round(avg(c), 6) AS "col" FROM cell_px WHERE label IN (2, 5) GROUP BY ALL')
def plot_centroids(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.centroids(_labels(spark, d), [2, 5]).select("image_id", "label", r6("row").alias("row"), r6("col").alias("col"))


@query(f"""WITH {S.LABELS} SELECT image_id, r AS "row", c AS "col", label, CAST(count(*) OVER (PARTITION BY image_id, label) AS DOUBLE) AS value FROM cell_px""")
def plot_coloured(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.coloured(_labels(spark, d), cell_area(spark, d), "area")


@query(f"""WITH {S.SCENE} SELECT image_id, r AS "row", c AS "col", CAST(ch AS INTEGER) AS channel, round(v / 1000.0, 6) AS value, CAST(nullif(label, 0) AS DOUBLE) AS label FROM px WHERE ch = 1""")
def plot_overlay(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.overlay(_pixels(spark, d), _labels(spark, d)).select(*AT, "channel", r6("value").alias("value"), F.col("label").cast("double").alias("label"))


@query(f"""WITH {S.BOTH} SELECT image_id, r AS "row", c AS "col", label, 'predicted' AS panel FROM pred_px UNION ALL SELECT image_id, r, c, label, 'truth' FROM cell_px""")
def plot_comparison(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.comparison(_predicted(spark, d), _labels(spark, d))


@query("""SELECT image_id, cell_id, area AS x, perimeter AS y FROM features""")
def plot_features(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.feature_points(load(spark, d, "features"), "area", "perimeter")


@query("""SELECT image_id, metric, value, CAST(row_number() OVER (PARTITION BY image_id ORDER BY value NULLS FIRST, metric) AS INTEGER) AS place FROM (SELECT DISTINCT * FROM metrics)""")
def plot_metrics(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.metric_bars(load(spark, d, "metrics").distinct())


def _model() -> models.TrainedModel:
    from datetime import datetime, timezone

    return models.TrainedModel("/models/a", "cellpose", "cyto3", {"dice": 0.9, "loss": [0.5, 0.25], "n_epochs": 100}, {"tissue": "breast"}, datetime(2025, 1, 2, 3, 4, 5, tzinfo=timezone.utc))


@query("""SELECT * FROM (VALUES ('Backend', 'cellpose'), ('Base Model', 'cyto3'), ('Model Path', '/models/a'), ('Created', '2025-01-02 03:04:05'), ('Metric: dice', '0.9'), ('Metric: loss', '0.5, 0.25'), ('Metric: n_epochs', '100'), ('tissue', 'breast')) AS t(field, value)""")
def model_card(spark: SparkSession, d: str) -> DataFrame:
    return _model().card(spark)


@query("""SELECT CAST(e AS INTEGER) AS epoch, CAST(x AS DOUBLE) AS loss FROM (VALUES (1, 0.5), (2, 0.25)) AS t(e, x)""")
def plot_losses(spark: SparkSession, d: str) -> DataFrame:
    return _model().losses(spark)


@query("""SELECT image_id, concat_ws('; ', CASE WHEN n_channels = 1 THEN n_rows || ' x ' || n_cols || ' (1 channel)' ELSE n_rows || ' x ' || n_cols || ' x ' || n_channels || ' (' || n_channels || ' channels: ' || coalesce(array_to_string(list_filter(channels, lambda x: x IS NOT NULL), ', '), '') || ')' END,
  CASE WHEN resolution.x_um IS NOT NULL AND NOT isnan(resolution.x_um) THEN 'Resolution: ' || printf('%.6f', floor(resolution.x_um * 1000000.0 + 0.5) / 1000000.0) || ' x ' || coalesce(printf('%.6f', floor(resolution.y_um * 1000000.0 + 0.5) / 1000000.0), 'NA') || ' um/px' END,
  CASE WHEN len(history) > 0 THEN 'History: ' || array_to_string(history, ' -> ') END) AS text FROM images""")
def print_images(spark: SparkSession, d: str) -> DataFrame:
    return printing.image_lines(load(spark, d, "images"))


@query("""SELECT image_id, concat_ws('; ', n_rows || ' x ' || n_cols || ', ' || n_cells || CASE WHEN n_cells = 1 THEN ' cell' ELSE ' cells' END, 'Method: ' || element_at(model_info, 'method')[1]) AS text FROM masks""")
def print_masks(spark: SparkSession, d: str) -> DataFrame:
    return printing.mask_lines(load(spark, d, "masks"))


@query(f"""WITH {S.LABELS} SELECT image_id, count(*) || ' cells; area min: ' || min(area) || ', median: ' || printf('%.1f', quantile_cont(area, 0.5)) || ', max: ' || max(area) AS text FROM (SELECT image_id, label, count(*) AS area FROM cell_px GROUP BY ALL) GROUP BY image_id""")
def print_summaries(spark: SparkSession, d: str) -> DataFrame:
    return printing.mask_summary_lines(_labels(spark, d))


@query("""SELECT image_id, metric, metric || ': ' || coalesce(printf('%.4f', floor(value * 10000.0 + 0.5) / 10000.0), 'NA') AS text FROM metrics""")
def print_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return printing.evaluation_lines(load(spark, d, "metrics"))


@query("""SELECT task_id, image_id, 'Patches: ' || n_patches || ' (' || patch_size || ' x ' || patch_size || ' px)' AS text FROM annotation_tasks""")
def print_tasks(spark: SparkSession, d: str) -> DataFrame:
    return printing.task_lines(load(spark, d, "annotation_tasks"))


@query(f"WITH {S.CELLS}, {S.IMAGES} SELECT image_id, 'Rounds: 3; Model: cellpose; Total patches: 30' AS text FROM imgs")
def print_loops(spark: SparkSession, d: str) -> DataFrame:
    return printing.loop_lines(annotate.active_rounds(annotate.annotation_task(_images(spark, d), n_patches=10, patch_size=16), 3))
