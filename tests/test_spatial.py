import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glebe.functions import geo
from glebe.operators import spatial, tree
from helpers import plan_of, rows


def km(a, b, c, d):
    r = math.radians
    x = math.sin(r(c - a) / 2) ** 2 + math.cos(r(a)) * math.cos(r(c)) * math.sin(r(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(x)))


def squared(a, b, c, d):
    return (c - a) ** 2 + (d - b) ** 2


@pytest.fixture(scope="module")
def clouds(spark):
    rng = random.Random(3)
    scattered = lambda n, p: [(f"{p}{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(n)]
    dense = lambda n, p, w: [(f"{p}{i}", 47 + rng.random() * w, -0.9 + rng.random() * w) for i in range(n)]
    sites = scattered(150, "s") + dense(40, "sd", .01) + [
        ("pole", 90., 0.), ("south", -89.9, 10.), ("east", 0., 179.99), ("west", 0., -180.), ("date", 0., 180.), ("zero", 0., 0.)]
    targets = scattered(1200, "t") + dense(300, "td", .02) + [(f"tt{i}", 47., -0.9) for i in range(9)] + [
        ("tp", 89.9, 170.), ("ta", 0., -179.99), ("tb", 0., 180.)]
    return (sites, targets, spark.createDataFrame(sites, "sid string, lat double, lon double"),
            spark.createDataFrame(targets, "tid string, latitude double, longitude double"))


@pytest.mark.parametrize("radius", [0.5, 20.0, 3000.0])
def test_radius_join_equals_brute_force(clouds, radius):
    sites, targets, s, t = clouds
    joined = spatial.radius_join(s, t, radius, cell_pairs=50).select("sid", "tid")
    expected = sorted((a[0], b[0]) for a in sites for b in targets if km(*a[1:], *b[1:]) <= radius)
    assert rows(joined, "sid", "tid") == expected
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


def test_radius_join_leaves_the_task_of_its_file(spark, clouds, tmp_path):
    for name, side in (("sites", clouds[2]), ("targets", clouds[3])):
        side.coalesce(1).write.parquet(str(tmp_path / name))
    joined = spatial.radius_join(*(spark.read.parquet(str(tmp_path / name)) for name in ("sites", "targets")), 20.0)
    assert joined.columns == ["sid", "lat", "lon", "tid", "latitude", "longitude", "distance_km"]
    km_again = geo.haversine_km(*(F.col(c) for c in ("lat", "lon", "latitude", "longitude")))
    assert joined.filter(F.col("distance_km") != km_again).count() == 0
    assert joined.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def shuffled_rows(plan):
    """Rows that all exchanges of a plan have written."""
    metric = plan.metrics().get("shuffleRecordsWritten")
    children = plan.children()
    return (metric.get().value() if metric.isDefined() else 0) + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_radius_join_sends_a_row_a_few_times(spark):
    """A shuffled row is a row on disk: no copy for each cell that a circle touches, nor for parts of cells that no task is short of."""
    rng = random.Random(8)
    place = lambda n: [(i, 47 + rng.random() * 3, 1 + rng.random() * 4) for i in range(n)]
    s, t = place(3000), place(3000)
    sites = spark.createDataFrame(s, "sid int, lat double, lon double")
    targets = spark.createDataFrame(t, "tid int, latitude double, longitude double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = spatial.radius_join(sites, targets, 20.0, cell_pairs=500).select("sid", "tid")
        got = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(tuple(r) for r in got) == sorted((a[0], b[0]) for a in s for b in t if abs(a[1] - b[1]) < 0.2 and km(*a[1:], *b[1:]) <= 20)
    assert shuffled_rows(plan) < 5 * len(s) + 2 * len(t)


@pytest.mark.parametrize("tile_rows", [100, 1_000_000])
def test_radius_join_of_a_crowded_spot(spark, tile_rows):
    """More points in a cell than one row holds, far more of one side than of the other, and rows that come twice."""
    rng = random.Random(9)
    place = lambda n: [(i // 2, 47.05 + rng.random() / 1e3, 0.05 + rng.random() / 1e3) for i in range(n)]
    crowd, few = place(2500), place(4) + [(None, 47.05, 0.05)] * 2
    for s, t in ((crowd, few), (few, crowd)):
        sites = spark.createDataFrame(s, "sid int, lat double, lon double")
        targets = spark.createDataFrame(t, "tid int, latitude double, longitude double")
        got = spatial.radius_join(sites, targets, 30.0, tile_rows=tile_rows).groupBy("sid", "tid").count().collect()
        expected = Counter((a[0], b[0]) for a in s for b in t)
        assert {(r.sid, r.tid): r["count"] for r in got} == expected


def test_radius_join_around_the_limit(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(300):
        lat, lon, angle, d = rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(0, 2 * math.pi), 20 * rng.choice([1 - 1e-9, 1 + 1e-6])
        a, p = d / 6371, math.radians(lat)
        q = math.asin(math.sin(p) * math.cos(a) + math.cos(p) * math.sin(a) * math.cos(angle))
        dl = math.atan2(math.sin(angle) * math.sin(a) * math.cos(p), math.cos(a) - math.sin(p) * math.sin(q))
        pairs.append((i, lat, lon, math.degrees(q), (lon + math.degrees(dl) + 180) % 360 - 180))
    s = spark.createDataFrame([p[:3] for p in pairs], "sid int, lat double, lon double")
    t = spark.createDataFrame([(p[0], *p[3:]) for p in pairs], "tid int, latitude double, longitude double")
    got = {r.sid for r in spatial.radius_join(s, t, 20.0).filter("sid = tid").collect()}
    assert got == {p[0] for p in pairs if km(*p[1:]) <= 20}


@pytest.mark.parametrize("metric, distance", [("haversine", km), ("planar", squared)])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_equals_brute_force(clouds, metric, distance, k):
    sites, targets, s, t = clouds
    got = {}
    for r in spatial.nearest(s, t, k, metric, tie_break=["tid"]).collect():
        got.setdefault(r.sid, []).append((r["rank"], r.tid, r.distance))
    for a in sites:
        expected = sorted((distance(*a[1:], *b[1:]), b[0]) for b in targets)[:k]
        mine = sorted(got[a[0]])
        assert [round(x[2], 6) for x in mine] == [round(e[0], 6) for e in expected]
    # Equal places: the smallest ids win.
    at = {r.tid for r in spatial.nearest(s.filter("sid = 'zero'").withColumns({"lat": F.lit(47.), "lon": F.lit(-0.9)}), t, 3, metric, tie_break=["tid"]).collect()}
    assert at == {"tt0", "tt1", "tt2"}


def test_nearest_with_fewer_targets_than_k(spark):
    s = spark.createDataFrame([("a", 1., 1.), ("b", None, 1.)], "sid string, lat double, lon double")
    t = spark.createDataFrame([("x", 2., 2.), ("y", 50., 60.), ("z", None, None)], "tid string, latitude double, longitude double")
    assert rows(spatial.nearest(s, t, 5).select("sid", "tid", "rank"), "rank") == [("a", "x", 1), ("a", "y", 2)]


def test_filters_around_a_point(spark):
    wells = spark.createDataFrame([("a", 47.835, -0.92), ("b", 47.87, 0.0), ("c", None, 1.0)], "code_bss string, latitude double, longitude double")
    assert [r.code_bss for r in spatial.within_radius(wells, 47.8474, -0.9416, 10).collect()] == ["a"]
    placed = spatial.by_distance(spatial.with_distance(wells, 47.8474, -0.9416, decimals=2)).collect()
    assert [r.code_bss for r in placed] == ["a", "b", "c"] and placed[1].distance_km is not None and placed[2].distance_km is None


def test_points_in_zones(spark):
    square = lambda x, y, w: [[[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]]
    zones = spark.createDataFrame([("small", square(0., 0., .3)), ("large", square(-20., -20., 60.)), ("far", square(100., 10., 1.))],
                                  "zone string, shape array<array<array<array<double>>>>")
    rng = random.Random(2)
    pts = [(i, rng.uniform(-25, 45), rng.uniform(-25, 45)) for i in range(300)] + [(300, .1, .1), (300, .1, .1), (301, 80., 80.), (302, None, 1.)]
    points = spark.createDataFrame(pts, "pid int, plat double, plon double")
    got = rows(spatial.points_in_zones(points, zones, "shape", "plat", "plon", max_cells_per_zone=16, hot_cell_rows=20).select("pid", "zone"))
    expected = []
    for i, lat, lon in pts:
        inside = [] if lat is None else [z for z, x, y, w in (("small", 0, 0, .3), ("large", -20, -20, 60), ("far", 100, 10, 1)) if x < lon < x + w and y < lat < y + w]
        expected += [(i, z) for z in inside] or [(i, None)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def crossings(shape, x, y):
    """Even-odd rule over all edges."""
    odd = False
    for ring in itertools.chain.from_iterable(shape):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("most_cells", [4, 64, 4096])
def test_zones_of_any_form_equal_the_even_odd_rule(spark, most_cells):
    """Rings that cross themselves, holes, several parts, rings left open, corners on borders of cells."""
    rng = random.Random(most_cells)
    corner = lambda: [round(rng.uniform(-3, 3), rng.choice([0, 1, 5])), round(rng.uniform(-3, 3), rng.choice([0, 1, 5]))]
    zones = []
    for i in range(25):
        shape = [[[corner() for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 3))]
        if i % 2:
            shape = [[ring + ring[:1] for ring in part] for part in shape]
        zones.append((f"z{i}", shape))
    pts = [(i, *corner()) for i in range(400)]
    got = spatial.points_in_zones(spark.createDataFrame(pts, "pid int, plat double, plon double"),
                                  spark.createDataFrame(zones, "zone string, shape array<array<array<array<double>>>>"),
                                  "shape", "plat", "plon", max_cells_per_zone=most_cells)
    want = []
    for i, y, x in pts:
        boxed = [(z, s) for z, s in zones if min(p[0] for g in s for r in g for p in r) <= x <= max(p[0] for g in s for r in g for p in r)
                 and min(p[1] for g in s for r in g for p in r) <= y <= max(p[1] for g in s for r in g for p in r)]
        want += [(i, z) for z, s in boxed if crossings(s, x, y)] or [(i, None)]
    assert sorted(rows(got.select("pid", "zone")), key=str) == sorted(want, key=str)


def test_a_zone_of_many_vertices(spark):
    """A ring of 100,000 corners around a circle, in and out by turns, cut into some thousand cells."""
    n = 100_000
    ring = [[(2 + 0.01 * (i % 2)) * math.cos(2 * math.pi * i / n), (2 + 0.01 * (i % 2)) * math.sin(2 * math.pi * i / n)] for i in range(n)]
    zones = spark.createDataFrame([("ring", [[ring + ring[:1]]])], "zone string, shape array<array<array<array<double>>>>")
    rng = random.Random(1)
    pts = [(i, r * math.sin(a), r * math.cos(a)) for i in range(5000) for r, a in [(rng.choice([rng.uniform(0, 1.999), rng.uniform(2.011, 2.9)]), rng.uniform(0, 7))]]
    points = spark.createDataFrame(pts, "pid int, plat double, plon double")
    got = rows(spatial.points_in_zones(points, zones, "shape", "plat", "plon").select("pid", "zone"))
    assert sorted(got) == [(i, "ring" if math.hypot(y, x) < 2 else None) for i, y, x in pts]


@pytest.mark.parametrize("n_sites, n_targets", [(3000, 40), (40, 3000), (400, 400)])
def test_a_crowded_cell_is_split_on_both_sides(spark, n_sites, n_targets):
    """All points lie in one cell and all pairs match; no task may hold them all."""
    place = lambda n, seed: [(i, 47.05 + random.Random(seed + i).random() / 1e3, 0.05 + random.Random(seed - i).random() / 1e3) for i in range(n)]
    s = spark.createDataFrame(place(n_sites, 1), "sid int, lat double, lon double").repartition(4)
    t = spark.createDataFrame(place(n_targets, 9), "tid int, latitude double, longitude double").repartition(4)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pairs = spatial.radius_join(s, t, 30.0, cell_pairs=2000).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in pairs.groupBy("task").count().collect()]
        assert sum(tasks) == n_sites * n_targets and len(tasks) > 8 and max(tasks) < 0.3 * sum(tasks)
        assert pairs.select("sid", "tid").distinct().count() == n_sites * n_targets
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("metric", ["haversine", "planar"])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_a_dense_town(spark, metric, k):
    """Most points within some hundred metres."""
    rng = random.Random(5)
    spot = lambda: (47 + rng.gauss(0, 5e-4), 2 + rng.gauss(0, 5e-4)) if rng.random() < .8 else (47 + rng.uniform(-2, 2), 2 + rng.uniform(-2, 2))
    t, s = [spot() for _ in range(500)], [spot() for _ in range(60)]
    targets = spark.createDataFrame([(i, *p) for i, p in enumerate(t)], "tid int, latitude double, longitude double")
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(s)], "sid int, lat double, lon double")
    distance = km if metric == "haversine" else lambda a, b, c, d: (c - a) ** 2 + (d - b) ** 2
    got = spatial.nearest(sites, targets, k, metric).select("sid", "rank", "tid")
    expected = [(i, r, j) for i, p in enumerate(s) for r, (_, j) in enumerate(sorted((distance(*p, *q), j) for j, q in enumerate(t))[:k], 1)]
    assert rows(got, "sid", "rank") == expected


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_nearest_where_all_targets_lie_within_a_metre(spark, metric):
    rng = random.Random(6)
    t = [(47 + rng.random() * 9e-6, 2 + rng.random() * 9e-6) for _ in range(6000)]
    s = [(47 + rng.random() * 9e-6, 2 + rng.random() * 9e-6) for _ in range(20)] + [(10.0, 10.0)]
    targets = spark.createDataFrame([(i, *p) for i, p in enumerate(t)], "tid int, latitude double, longitude double").repartition(3)
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(s)], "sid int, lat double, lon double")
    distance = km if metric == "haversine" else squared
    for k in (1, 3):
        got = {(r.sid, r["rank"]): r.distance for r in spatial.nearest(sites, targets, k, metric).collect()}
        for i, p in enumerate(s):
            nearest = sorted(distance(*p, *q) for q in t)[:k]
            assert [got[i, r + 1] for r in range(k)] == pytest.approx(nearest, rel=1e-6, abs=1e-15)


def test_leaves_and_nodes_are_bounded(spark):
    """However points lie, a leaf has 64 at most and a node 64 below it, over several partitions too."""
    rng = random.Random(7)
    rows = [(47 + (rng.random() if i % 10 == 0 else 1e-6 * rng.random()), 2.0 + 1e-9 * i) for i in range(9000)] + [(91.0, 0.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = tree.build(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert built.points.count() == 9000
    leaves = built.leaf_points().groupBy("_node").count().agg(F.max("count"), F.sum("count")).first()
    assert leaves[0] <= 64 and leaves[1] == 9000
    sizes = built.nodes.selectExpr("_shift", "size(_children) AS n", "aggregate(_children, 0L, (a, c) -> a + c._n) AS points").collect()
    assert max(r.n for r in sizes) <= 64 and len(built.shifts) == 2
    assert {shift: sum(r.points for r in sizes if r["_shift"] == shift) for shift in built.shifts} == dict.fromkeys(built.shifts, 9000)
    assert tree._levels({0: 40}) == (6,) and tree._levels({0: 1 << 20}) == (18, 12, 6) and tree._levels({}) == (6,)
    assert tree._levels(dict.fromkeys(range(1000), 50)) == (39, 6)
