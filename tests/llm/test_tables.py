import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import clusters, percentiles, splits, subset

rng = np.random.default_rng(11)
CELLS = "image_id bigint, cell_id int, area_px double, circularity double, eccentricity double, solidity double, group_id string"


def shapes(n):
    kinds = [(2.0, 1.05, 0.3, 1.1), (2.7, 0.9, 0.45, 1.0), (2.4, 0.4, 0.95, 0.9), (3.4, 0.4, 0.5, 0.8)]
    rows, truth = [], {}
    for k, (size, *rest) in enumerate(kinds):
        for i in range(n // (k + 1)):
            x = [rng.normal(m, s) for m, s in zip((size, *rest), (0.06, 0.03, 0.02, 0.02))]
            rows.append((k, i, float(10 ** x[0]), *map(float, x[1:]), "?"))
            truth[k, i] = k
    rows += [(50, i, float(10 ** rng.uniform(1, 4)), *map(float, rng.uniform(0.2, 1.4, 3)), "?") for i in range(8)]
    rows += [(60, 1, 0.0, None, 0.3, 1.1, "?"), (60, 2, None, None, None, float("nan"), "?"), (60, 3, 100.0, 1.05, None, None, "?"), (None, 4, 100.0, 1.05, 0.3, 1.1, "?"), rows[0]]
    return rows, truth


def test_groups(spark):
    rows, truth = shapes(900)
    cells = clusters.shapes(spark.createDataFrame(rows, CELLS)).cache()
    groups = clusters.find_groups(cells)
    assert len(groups.centres) == 4 and groups.rounds > 0
    out = {(r.image_id, r.cell_id): r.group_id for r in clusters.assign(cells, groups).collect()}
    assert sum(out[c] is None for c in truth) < 5
    assert all(len({out[c] for c in truth if truth[c] == k} - {None}) == 1 for k in range(4))
    assert out[60, 1] is None and out[60, 2] is None and out[60, 3] == out[0, 0]
    assert sum(out[50, i] is not None for i in range(8)) <= 1
    pairs = spark.createDataFrame([(1, 0, 1, 0, 2), (2, 0, 1, 1, 1), (3, 0, 1, 60, 2), (4, 0, 1, 999, 1), (1, 0, 1, 0, 2)], "pair_id bigint, image_id_a bigint, cell_id_a int, image_id_b bigint, cell_id_b int")
    assert [r.pair_id for r in clusters.same_group(pairs, cells, groups).collect()] == [1]
    d = clusters.describe(clusters.assign(cells, groups), typical=3).collect()
    assert len(d) == 12 and {r.group_id: r.n_cells for r in d}[1] >= 890
    few = clusters.find_groups(cells.limit(5))
    assert few is None and clusters.assign(cells, few).where("group_id is not null").count() == 0


def test_small_groups_set_apart(spark, monkeypatch):
    kinds = [(12_000, (2.0, 1.05, 0.3, 1.1)), (8000, (2.7, 0.9, 0.45, 1.0)), (30, (3.6, 0.5, 0.9, 0.8))]
    rows = [(k, i, float(10 ** rng.normal(m[0], 0.03)), *map(float, rng.normal(m[1:], 0.01)), "?") for k, (n, m) in enumerate(kinds) for i in range(n)]
    cells = clusters.shapes(spark.createDataFrame(rows, CELLS)).cache()
    groups = clusters.find_groups(cells)
    assert len(groups.centres) == 3
    out = clusters.assign(cells, groups).where("image_id = 2").groupBy("group_id").count().collect()
    assert max(r["count"] for r in out if r.group_id) >= 28
    monkeypatch.setattr(clusters, "MAX_LEAVES", 1)
    monkeypatch.setattr(clusters, "COMPACT", 0.001)
    with pytest.raises(ValueError):
        clusters.find_groups(cells)


ROWS = "image_id bigint, day date, tie bigint, a double, b double"


@pytest.mark.parametrize("n,whole", [(0, 65_536), (1, 65_536), (40, 65_536), (30_000, 65_536), (30_000, 500)])
def test_percentiles(spark, n, whole, monkeypatch):
    monkeypatch.setattr(percentiles, "WHOLE", whole)
    monkeypatch.setattr(percentiles, "CHUNK", min(4096, whole // 3))
    monkeypatch.setattr(percentiles, "PARTITION", 20_000)
    # one group holds most rows and one value most of those
    data = [(int(i), dt.date(2024, 1, 1 + int(d)), k, float(v), None if k % 5 == 0 else float(v) / 2) for k, (i, d, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], n), rng.integers(0, 3, n), np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, n))))]
    if n:
        data += [(None, None, -1, 5.0, float("nan")), (9, dt.date(2024, 1, 1), -2, None, None)]
    out = percentiles.percentiles(spark.createDataFrame(data, ROWS), ["a", "b"]).collect()
    groups = {}
    for i, d, _, a, b in data:
        for m, v in (("a", a), ("b", b)):
            if v is not None and v == v:
                for key in (("image_day", m, i, d), ("image", m, i, None), ("day", m, None, d)):
                    groups.setdefault(key, []).append(v)
    got = {(r.level, r.metric, r.image_id, r.day): r for r in out}
    assert set(got) == set(groups) and len(out) == len(got)
    for k, v in groups.items():
        assert got[k].n == len(v)
        assert np.allclose([got[k][percentiles.name(q)] for q in percentiles.QUANTILES], np.quantile(v, percentiles.QUANTILES))
        assert len(got[k].summary) == min(len(v), percentiles.POINTS) and got[k].summary == sorted(got[k].summary)
    if not n:
        return
    parts = spark.createDataFrame([r for r in out if r.level == "image_day"], "level string, metric string, image_id bigint, day date, n bigint, " + ", ".join(f"{percentiles.name(q)} double" for q in percentiles.QUANTILES) + ", rank_error double, summary array<double>")
    for r in percentiles.combine(parts, ["metric", "image_id"]).collect():
        v = np.sort(groups["image", r.metric, r.image_id, None])
        assert r.n == len(v) and r.rank_error <= 1 / percentiles.POINTS
        for q in percentiles.QUANTILES:
            x, slack = r[percentiles.name(q)], r.rank_error * len(v) + 1
            assert np.searchsorted(v, x, "left") - slack <= q * len(v) <= np.searchsorted(v, x, "right") + slack


def test_measurements_count_copies_once(spark):
    t = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(1, 1, "a", t, 5.0, "x"), (1, 1, "a", t, 5.0, "y"), (1, 1, "b", t, 5.0, "x"), (1, 2, "a", None, None, "x")], "image_id bigint, cell_id int, tool string, extracted_at timestamp, area double, loaded_at string")
    assert percentiles.measurements(df, ["area"]).count() == 3


def test_densities_and_choice(spark):
    crowd = [(1, i, 200.0 + rng.random(), 100 + rng.random()) for i in range(4000)]
    rare = [(2, i, float(200 * 2.0 ** (i + 2)), 100.0 + 3000 * i) for i in range(30)]
    odd = [(3, 1, None, None), (3, 2, 0.0, float("nan")), crowd[0], (None, 1, 5.0, 5.0)]
    cells = spark.createDataFrame(crowd + rare + odd, "image_id bigint, cell_id int, area_px double, centroid_row_px double")
    records = subset.cell_records(cells).cache()
    assert records.count() == 4032
    dense = subset.densities(records).cache()
    by = {r.image_id: r for r in dense.groupBy("image_id").agg(F.avg("density").alias("d"), F.count("*").alias("n")).collect()}
    assert by[1].d > 2500 and by[2].d < 3
    out = subset.choose(dense, {1: 40, 2: 3000, 3: 10**6, 4: 4031}).collect()
    chosen = [r for r in out if r.request_id == 1]
    assert len(chosen) == 40 == len({(r.image_id, r.cell_id) for r in chosen}) and sum(r.image_id == 2 for r in chosen) >= 28
    assert [sum(r.request_id == q for r in out) for q in (2, 3, 4)] == [3000, 4032, 4031]
    assert subset.choose(dense.limit(0), {1: 5}).count() == 0
    assert subset.densities(records.limit(0)).count() == 0


def test_densities_are_exact(spark, monkeypatch):
    monkeypatch.setattr(subset, "CHUNK_BITS", 6, raising=False)
    # equal records of a place of their own share all buckets and nothing else does
    sizes = [1] * 3000 + [2] * 500 + [7] * 200 + [900, 4000]
    rows = [(p, i, None, None, p, float(rng.integers(0, 9)) if n == 1 else 5.0, None if p % 3 else 2.5, 0.0) for p, n in enumerate(sizes) for i in range(n)]
    records = spark.createDataFrame(rows, "image_id bigint, cell_id int, task_id bigint, patch_id int, place bigint, x0 double, x1 double, x2 double")
    out = subset.densities(records).collect()
    assert len(out) == len(rows) and all(r.density == sizes[r.image_id] for r in out)
    # near records share a part of their buckets
    x = rng.normal(size=(3000, 3)) * 4
    near = spark.createDataFrame([(0, i, None, None, 0, *map(float, v)) for i, v in enumerate(x)], records.schema)
    want = np.zeros(len(x))
    for b in subset._buckets(np.zeros(len(x), np.int64), x):
        _, at, n = np.unique(b, return_inverse=True, return_counts=True)
        want += n[at] / subset.REPEATS
    got = {r.cell_id: r.density for r in subset.densities(near).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_subsets(spark):
    patches = spark.createDataFrame([(1, None, k, 1 + k % 2, 64 + k % 2, 1, 64, "s") for k in range(30)] + [(2, 7, 1, 500, 563, 900, 963, "s"), (2, 7, 1, 500, 563, 900, 963, "t"), (None, None, None, None, None, None, None, "s")], "task_id bigint, image_id bigint, patch_id int, row_start int, row_end int, col_start int, col_end int, density string")
    tasks = spark.createDataFrame([(1, None, "IMG-0005"), (2, 7, None)], "task_id bigint, image_id bigint, image_ref string")
    records = subset.patch_records(patches, tasks)
    assert records.count() == 32 and records.where("image_id = 5").count() == 30
    requests = spark.createDataFrame([(1, "patches", 3), (2, "none", 5), (3, "patches", 100), (4, None, 2), (5, "patches", None)], "request_id bigint, population string, subset_size int")
    out = subset.subsets(requests, {"patches": records}).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in out} == {1: 3, 3: 32}
    seen = subset.coverage(requests, {"patches": records}).groupBy("request_id").agg(F.sum("n_population").alias("n"), F.sum("n_chosen").alias("k")).collect()
    assert {r.request_id: (r.n, r.k) for r in seen} == {1: (32, 3), 3: (32, 32)}


def test_draw_follows_the_weights(spark, monkeypatch):
    monkeypatch.setattr(subset, "BINS", 8)
    dense = spark.range(3000).select(F.col("id").alias("image_id"), F.lit(None).cast("int").alias("cell_id"), F.lit(None).cast("bigint").alias("task_id"), F.lit(None).cast("int").alias("patch_id"), F.when(F.col("id") < 300, 1.0).otherwise(20.0).alias("density"))
    out = subset.choose(dense.cache(), {q: 100 for q in range(20)}).collect()
    assert len(out) == 2000 and all(len({r.image_id for r in out if r.request_id == q}) == 100 for q in range(20))
    # weights are 300 and 135, and lone records are used up as the draw goes on
    assert 0.58 < sum(r.image_id < 300 for r in out) / 2000 < 0.72


IMAGES = "image_id bigint, site string, metadata map<string,string>, root_id string"
MASKS = "image_id bigint, model_info map<string,string>, created_at timestamp, a string"
TASKS = "task_id bigint, image_id bigint, image_ref string, created_at timestamp, b string"


def related(spark):
    images = [
        (1, "x", {"patient": "PT_0007"}), (2, "x", {"Pat-Nr": "#7 "}), (3, "y", {"patient": "7"}), (4, "x", {"patient": "none"}), (5, "x", {"subject": "n.n."}), (6, None, {"patient": "7"}),
        (10, "x", {"rescan_of": "IMG-0000011"}), (11, "x", {"header": '{"origin": 12, "level": 1}'}), (12, "x", {}), (13, "x", {"note": "tray 4; compare stain depth with IMG-0000012"}),
        (14, "x", {"note": "objective 9x; Ausschnitt aus image no. 12"}), (15, "x", {"derived_from_2": "999"}), (16, "x", {"parent": "16.tif"}), (20, "x", None), (21, "x", {}), (22, "x", {"note": "same glass as IMG23_v2.png, scanned again"}), (23, "x", {}), (23, "x", {}),
    ]
    t = dt.datetime(2024, 1, 1)
    masks = [(20, {"registered_to": " ２１ "}, t, "m"), (3, None, t, "m"), (None, None, t, "m"), (None, None, t, "m"), (999, {"registered_to": "1"}, t, "m")]
    tasks = [(1, 4, None, t, "m"), (1, None, "img_3", t, "m"), (2, None, None, t, "m"), (1, 4, None, t, "m"), (None, 5, None, t, "m"), (None, 13, None, t, "m")]
    return spark.createDataFrame([(*i, "r") for i in images], IMAGES), spark.createDataFrame(masks, MASKS), spark.createDataFrame(tasks, TASKS)


def test_families(spark):
    forest = splits.spanning_forest(splits.relations(*related(spark)))
    found = {(r.root_id, r.image_id) for r in splits.families(forest).collect()}
    assert found == {(1, 2), (3, 4), (10, 11), (10, 12), (10, 14), (20, 21), (22, 23)}
    nodes, edges = forest.roots.count(), forest.edges.count()
    assert edges == nodes - forest.roots.select("root").distinct().count()


def test_forest_against_union_find(spark):
    pairs = {tuple(sorted(map(int, rng.integers(0, 300, 2)))) for _ in range(220)} | {(400 + i, 401 + i) for i in range(60)} | {(600, 601 + i) for i in range(80)}
    pairs = {p for p in pairs if p[0] != p[1]}
    forest = splits.spanning_forest(spark.createDataFrame(list(pairs), "a bigint, b bigint"))

    def classes(edges):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(a)] = root(b)
        out = {}
        for x in list(up):
            out.setdefault(root(x), set()).add(x)
        return {frozenset(v) for v in out.values()}

    tree = [(r.a, r.b) for r in forest.edges.collect()]
    got = {}
    for r in forest.roots.collect():
        got.setdefault(r.root, set()).add(r.node)
    assert classes(pairs) == classes(tree) == {frozenset(v) for v in got.values()}
    assert len(tree) == sum(len(v) - 1 for v in classes(pairs)) and set(tree) <= pairs
    assert splits.spanning_forest(spark.createDataFrame([], "a bigint, b bigint")).roots.count() == 0


def test_splits(spark):
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0), (None, 0.3)], "split_name string, target_share double")
    out = splits.assign(*related(spark), targets)
    assert out.count() == 11 and out.where("split_name is null").count() == 0
    assert out.where("root_id is not null").groupBy("root_id").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    many = spark.range(4000).select((F.col("id") % 1500).alias("family"), F.lit(None).cast("string").alias("split_name_old"))
    shares = {r.split_name: r["count"] / 4000 for r in splits.split_records(many, ["family"], targets).groupBy("split_name").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.02
    assert splits.split_records(many.limit(0), ["family"], targets).count() == 0
    # large families miss the shares, small ones make up for them
    sizes = [300, 200, 90, 60, 40, 33, *[3] * 80, *[1] * 300]
    mixed = spark.createDataFrame([(f, None) for f, n in enumerate(sizes) for _ in range(n)], "family bigint, split_name_old string")
    shares = {r.split_name: r["count"] / sum(sizes) for r in splits.split_records(mixed, ["family"], targets).groupBy("split_name").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.005 and abs(shares["test"] - 0.1) < 0.005 and abs(shares["validation"] - 0.1) < 0.005
