"""SQL of the scene and of what many checks share, for the engine the driver compares with."""

from __future__ import annotations

CELLS = """cells AS (
  SELECT CAST(c_custkey // 15 AS BIGINT) AS image_id, CAST(c_custkey % 15 + 1 AS INTEGER) AS k,
         4 + (c_custkey * 37) % 57 AS cr, 4 + (c_custkey * 53 + 11) % 57 AS cc, 3 + c_custkey % 5 AS rx, 3 + (c_custkey // 5) % 5 AS ry
  FROM customer)"""


def _painted(name: str, shift: str, flat: str, where: str) -> str:
    return f"""{name} AS (
  SELECT image_id, CAST(cr {shift} + d AS INTEGER) AS r, CAST(cc + e AS INTEGER) AS c, max(k) AS label
  FROM cells, range(-8, 9) AS dr(d), range(-8, 9) AS de(e)
  WHERE {where} AND d * d * ry * ry + e * e * (rx {flat}) * (rx {flat}) <= (rx {flat}) * (rx {flat}) * ry * ry
    AND cr {shift} + d BETWEEN 1 AND 64 AND cc + e BETWEEN 1 AND 64
  GROUP BY ALL)"""


CELL_PX = _painted("cell_px", "", "", "true")
PRED_PX = _painted("pred_px", "+ 1", "- 1", "k % 7 <> 0")
IMAGES = "imgs AS (SELECT DISTINCT image_id FROM cells)"
GRID = "grid AS (SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM imgs, range(1, 65) AS a(r), range(1, 65) AS b(c))"
#: Pixels with label (0 for none) and the value in thousandths of channels 1 to 4.
PX = """px AS (
  SELECT image_id, r, c, coalesce(label, 0) AS label, ch,
         CASE WHEN coalesce(label, 0) > 0 THEN ((600 + (label * 27) % 400) * (5 - ch)) // 4 ELSE 50 END + (r * 31 + c * 17 + image_id * 7) % 21 - 10 AS v
  FROM grid LEFT JOIN cell_px USING (image_id, r, c), (VALUES (1), (2), (3), (4)) AS t(ch))"""
EMB = """emb AS (
  SELECT CAST(vec_id // 64 AS BIGINT) AS image_id, CAST(vec_id % 64 + 1 AS INTEGER) AS r, CAST(p AS INTEGER) AS c, CAST(embedding[p] AS DOUBLE) AS value,
         CAST(max(vec_id % 64 + 1) OVER (PARTITION BY vec_id // 64) AS INTEGER) AS n_rows
  FROM embeddings, range(1, 65) AS t(p))"""
LABELS = f"{CELLS}, {CELL_PX}"
BOTH = f"{LABELS}, {PRED_PX}"
SCENE = f"{LABELS}, {IMAGES}, {GRID}, {PX}"
#: Labelled pixels that are on the image's edge or beside another label or none.
BORDER = """beside AS (
  SELECT *, lag(label) OVER a AS l1, lag(c) OVER a AS c1, lead(label) OVER a AS l2, lead(c) OVER a AS c2, lag(label) OVER d AS l3, lag(r) OVER d AS r3, lead(label) OVER d AS l4, lead(r) OVER d AS r4
  FROM cell_px WINDOW a AS (PARTITION BY image_id, r ORDER BY c), d AS (PARTITION BY image_id, c ORDER BY r)),
edge_px AS (
  SELECT image_id, r, c, label,
         NOT (coalesce(c1 = c - 1 AND l1 = label, false) AND coalesce(c2 = c + 1 AND l2 = label, false) AND coalesce(r3 = r - 1 AND l3 = label, false) AND coalesce(r4 = r + 1 AND l4 = label, false)) AS is_border
  FROM beside)"""
SHAPE = """shape AS (
  SELECT image_id, label, count(*) AS area, CAST(sum(CAST(is_border AS INTEGER)) AS DOUBLE) AS perimeter,
         CAST(count(*) AS DOUBLE) AS n, CAST(sum(r) AS DOUBLE) AS sr, CAST(sum(c) AS DOUBLE) AS sc, CAST(sum(r * r) AS DOUBLE) AS srr, CAST(sum(c * c) AS DOUBLE) AS scc, CAST(sum(r * c) AS DOUBLE) AS src,
         min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1
  FROM edge_px GROUP BY image_id, label),
axes AS (
  SELECT *, CASE WHEN n > 1 THEN (n * srr - sr * sr) / (n * (n - 1)) END AS va, CASE WHEN n > 1 THEN (n * scc - sc * sc) / (n * (n - 1)) END AS vd,
         CASE WHEN n > 1 THEN (n * src - sr * sc) / (n * (n - 1)) END AS vb
  FROM shape),
moments AS (
  SELECT *, (va + vd) / 2 AS m, sqrt(((va - vd) / 2) * ((va - vd) / 2) + vb * vb) AS q,
         4 * pi() * area / (perimeter * perimeter) AS circularity
  FROM axes),
cell_shape AS (
  SELECT *, CASE WHEN n > 1 AND m - q > 1e-9 THEN sqrt(1 - (m - q) / (m + q)) END AS eccentricity FROM moments)"""
SHAPES = f"{LABELS}, {BORDER}, {SHAPE}"
#: Vertices of each cell's convex hull: ends of rows whose steepest way back is gentler than the way on.
HULL = """ends AS (SELECT image_id, label, r, min(c) AS a, max(c) AS b, count(*) AS m FROM cell_px GROUP BY ALL),
slopes AS (
  SELECT x.image_id, x.label, x.r, x.a, x.b,
         max(CASE WHEN y.r < x.r THEN CAST(x.a - y.a AS DOUBLE) / (x.r - y.r) END) AS la, min(CASE WHEN y.r > x.r THEN CAST(y.a - x.a AS DOUBLE) / (y.r - x.r) END) AS ra,
         min(CASE WHEN y.r < x.r THEN CAST(x.b - y.b AS DOUBLE) / (x.r - y.r) END) AS lb, max(CASE WHEN y.r > x.r THEN CAST(y.b - x.b AS DOUBLE) / (y.r - x.r) END) AS rb
  FROM ends x JOIN ends y USING (image_id, label) GROUP BY ALL),
vertices AS (
  SELECT image_id, label, r, a AS c, -1 AS side FROM slopes WHERE la IS NULL OR ra IS NULL OR la < ra - 1e-12
  UNION ALL SELECT image_id, label, r, b, 1 FROM slopes WHERE lb IS NULL OR rb IS NULL OR lb > rb + 1e-12),
strips AS (SELECT *, lag(r) OVER w AS r0, lag(c) OVER w AS c0 FROM vertices WINDOW w AS (PARTITION BY image_id, label, side ORDER BY r)),
hulls AS (
  SELECT image_id, label, CASE WHEN n < 3 THEN n ELSE area END AS hull_area FROM
    (SELECT image_id, label, coalesce(sum(side * (r - r0) * (c + c0) / 2.0), 0) AS area FROM strips GROUP BY image_id, label)
    JOIN (SELECT image_id, label, CAST(sum(m) AS BIGINT) AS n FROM ends GROUP BY image_id, label) USING (image_id, label))"""
OVERLAPS = """pairs AS (SELECT image_id, p.label AS pred, g.label AS gt, count(*) AS inter FROM pred_px p JOIN cell_px g USING (image_id, r, c) GROUP BY ALL),
pa AS (SELECT image_id, label AS pred, count(*) AS pred_area FROM pred_px GROUP BY ALL),
ga AS (SELECT image_id, label AS gt, count(*) AS gt_area FROM cell_px GROUP BY ALL),
iou AS (SELECT *, CAST(inter AS DOUBLE) / (pred_area + gt_area - inter) AS iou FROM pairs JOIN pa USING (image_id, pred) JOIN ga USING (image_id, gt))"""
HISTOGRAM = """lim AS (SELECT image_id, min(v / 1000.0) AS lo, max(v / 1000.0) AS hi FROM px WHERE ch = 1 GROUP BY image_id),
binned AS (
  SELECT image_id, CAST(greatest(1, least(256, ceil((v / 1000.0 - lo) / ((hi - lo) / 256) - 1e-7))) AS INTEGER) AS bin, lo, (hi - lo) / 256 AS w FROM px JOIN lim USING (image_id) WHERE ch = 1),
hist AS (SELECT image_id, bin, count(*) AS n, any_value(lo) + (bin - 0.5) * any_value(w) AS mid, any_value(lo) AS lo, any_value(w) AS w FROM binned GROUP BY image_id, bin)"""
OTSU = """sums AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS DOUBLE) AS wb, sum(n * mid) OVER (PARTITION BY image_id ORDER BY bin) AS sb,
         CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS t, sum(n * mid) OVER (PARTITION BY image_id) AS s FROM hist),
ranked AS (
  SELECT image_id, mid, row_number() OVER (PARTITION BY image_id ORDER BY round(wb * (t - wb) * (sb / wb - (s - sb) / (t - wb)) * (sb / wb - (s - sb) / (t - wb)), 9) DESC, bin) AS k FROM sums WHERE t > wb),
otsu AS (SELECT image_id, mid AS threshold FROM ranked WHERE k = 1)"""


def stencil(source: str, value: str, half: int, how: str) -> str:
    """The square aggregate around each pixel of ``source`` by a plain range self-join, one axis after the other."""
    return f"""along AS (SELECT image_id, r, c, {how}({value}) OVER (PARTITION BY image_id, r ORDER BY c RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS x FROM {source}),
square AS (SELECT image_id, r, c, {how}(x) OVER (PARTITION BY image_id, c ORDER BY r RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS x FROM along)"""


def components(source: str, out: str) -> str:
    """4-connected components of the pixels of ``source`` by a recursion over runs; needs WITH RECURSIVE."""
    p = f"{out}_"
    return f"""{p}lone AS (SELECT image_id, r, c, c - row_number() OVER (PARTITION BY image_id, r ORDER BY c) AS i FROM {source}),
{p}runs AS MATERIALIZED (SELECT image_id, r, min(c) AS a, max(c) AS b, (r - 1) * 64 + min(c) - 1 AS node FROM {p}lone GROUP BY image_id, r, i),
{p}near AS MATERIALIZED (SELECT x.image_id, x.node AS u, y.node AS v FROM {p}runs x JOIN {p}runs y ON x.image_id = y.image_id AND abs(x.r - y.r) = 1 AND x.a <= y.b AND x.b >= y.a),
{p}reach AS (SELECT image_id, node, node AS root FROM {p}runs UNION SELECT n.image_id, n.v, g.root FROM {p}reach g JOIN {p}near n ON n.image_id = g.image_id AND n.u = g.node WHERE g.root < n.v),
{p}roots AS (SELECT image_id, node, min(root) AS root FROM {p}reach GROUP BY image_id, node),
{p}named AS (SELECT image_id, node, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM {p}roots),
{out} AS MATERIALIZED (SELECT s.image_id, s.r, s.c, n.label FROM {p}runs u JOIN {p}named n USING (image_id, node) JOIN {source} s ON s.image_id = u.image_id AND s.r = u.r AND s.c BETWEEN a AND b)"""


def filled(source: str, out: str) -> str:
    """Pixels of the dense ``source`` (``v``) that are on or can't be reached from the edge; needs WITH RECURSIVE."""
    return f"""{out}_off AS MATERIALIZED (SELECT image_id, r, c FROM {source} WHERE v = 0),
{out}_outside AS (SELECT image_id, r, c FROM {out}_off WHERE r IN (1, 64) OR c IN (1, 64)
  UNION SELECT o.image_id, o.r, o.c FROM (SELECT image_id, r + dr AS r, c + dc AS c FROM {out}_outside, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)) s JOIN {out}_off o USING (image_id, r, c)),
{out} AS MATERIALIZED (SELECT image_id, r, c FROM {source} ANTI JOIN {out}_outside USING (image_id, r, c))"""


def grown(source: str, out: str, rounds: int, allowed: str | None = None) -> str:
    """``source`` grown for ``rounds`` by a recursion that carries the pixels of the last two rounds; needs WITH RECURSIVE.

    A new pixel's labelled neighbours joined in the last round, and so it is new if it isn't of the last two."""
    only = f"SEMI JOIN {allowed} USING (image_id, r, c)" if allowed else ""
    return f"""{out}_all AS (
  SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, label, 0 AS k, 0 AS age FROM {source}
  UNION ALL
  SELECT * FROM (
    SELECT image_id, r, c, label, k, 0 FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id, r, c ORDER BY n DESC, label) AS place FROM (
        SELECT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c, label, k + 1 AS k, count(*) AS n
        FROM {out}_all, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)
        WHERE age = 0 AND k < {rounds} AND r + dr BETWEEN 1 AND 64 AND c + dc BETWEEN 1 AND 64 GROUP BY ALL) ANTI JOIN {out}_all USING (image_id, r, c) {only}) WHERE place = 1
    UNION ALL SELECT image_id, r, c, label, k, 1 FROM {out}_all WHERE age = 0)),
{out} AS MATERIALIZED (SELECT image_id, r, c, label FROM {out}_all WHERE age = 0)"""


def opened(source: str, out: str) -> str:
    """``v`` of the dense ``source`` after an opening of 5 pixels."""
    second = stencil("eroded", "v", 2, "max").replace("along", "along2").replace("square", "square2")
    return f"""{stencil(source, "v", 2, "min")}, eroded AS (SELECT image_id, r, c, CASE WHEN r > 2 AND r <= 62 AND c > 2 AND c <= 62 THEN x ELSE 0 END AS v FROM square),
{second}, {out} AS MATERIALIZED (SELECT image_id, r, c, CASE WHEN r > 2 AND r <= 62 AND c > 2 AND c <= 62 THEN x ELSE 0 END AS v FROM square2)"""


def distances(source: str, out: str) -> str:
    """L1 distance ``d`` of each pixel of the dense ``source`` to the nearest that is on."""
    return f"""{out}_v AS (SELECT image_id, r, c, least(r - max(CASE WHEN v = 1 THEN r END) OVER (PARTITION BY image_id, c ORDER BY r), min(CASE WHEN v = 1 THEN r END) OVER (PARTITION BY image_id, c ORDER BY r DESC) - r) AS up FROM {source}),
{out} AS MATERIALIZED (SELECT a.image_id, a.r, a.c, CAST(min(b.up + abs(a.c - b.c)) AS INTEGER) AS d FROM {out}_v a JOIN {out}_v b ON a.image_id = b.image_id AND a.r = b.r GROUP BY ALL)"""


def seeds(source: str, out: str, h: float) -> str:
    """Components of the pixels of ``source`` whose turned distance exceeds ``h`` of the greatest; needs WITH RECURSIVE."""
    return f"""{distances(source, f"{out}_d")}, {out}_close AS MATERIALIZED (SELECT image_id, r, c FROM (SELECT *, max(d) OVER (PARTITION BY image_id) + 1 AS far FROM {out}_d) WHERE far - d > far * {h}),
{components(f"{out}_close", out)}"""
