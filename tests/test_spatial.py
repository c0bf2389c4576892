import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlake.functions.geo import sphere
from emberlake.operators import neighbours as N
from emberlake.operators import skew
from emberlake.operators import spatial as P

POINT = "p string, lat double, lon double"
TARGET = "t string, lat double, lon double"


def brute(points, targets, sy=1.0, sx=1.0):
    out = {}
    for p, y, x in points:
        out[p] = min(((y * sy - b * sy) ** 2 + (x * sx - c * sx) ** 2, t) for t, b, c in targets)
    return out


def check(spark, points, targets, **kw):
    got = P.nearest(spark.createDataFrame(points, POINT), spark.createDataFrame(targets, TARGET), "p", "t", **kw)
    sy, sx = kw.get("scale", (1.0, 1.0))
    want = brute(points, targets, sy, sx)
    rows = {r.p: (r.distance, r.t) for r in got.collect()}
    assert len(rows) == len(points)
    for p, (d2, t) in want.items():
        assert rows[p][0] == pytest.approx(math.sqrt(d2), abs=1e-9) and rows[p][1] == t


def test_nearest_with_clusters_copies_and_far_points(spark):
    rnd = random.Random(3)
    targets = [(f"c{i:03d}", 50 + rnd.gauss(0, 0.001), -120 + rnd.gauss(0, 0.001)) for i in range(150)]  # a dense cluster
    targets += [(f"u{i:03d}", rnd.uniform(48, 60), rnd.uniform(-139, -114)) for i in range(60)]
    targets += [("zcopy", *targets[5][1:]), ("acopy", *targets[5][1:])]  # copies: the smallest id wins
    points = [(f"h{i}", 50.0, -120.0) for i in range(150)]  # a third of the points at one place
    points += [(f"p{i}", rnd.uniform(47, 61), rnd.uniform(-141, -112)) for i in range(150)]
    points += [("south", -45.0, 100.0), ("zero", 0.0, 0.0), ("exact", *targets[5][1:])]
    check(spark, points, targets)
    check(spark, points, targets, scale=(111.0, 65.2))


def test_clustered_targets_are_split_where_they_are_full(spark):
    rnd = random.Random(8)
    points = [(f"p{i}", rnd.uniform(48, 60), rnd.uniform(-139, -114)) for i in range(300)]
    points += [(f"q{i}", 50 + rnd.uniform(0, 0.05), -120 + rnd.uniform(0, 0.05)) for i in range(300)]
    spot = lambda n: [(f"t{i:05d}", 50 + rnd.uniform(0, 0.05), -120 + rnd.uniform(0, 0.05)) for i in range(n)]
    few = [*spot(3000), ("far", 59.0, -115.0), ("copy", 50.01, -120.0), ("acopy", 50.01, -120.0)]
    check(spark, points, few)
    check(spark, points, few, scale=(111.0, 65.2))

    def pairs(targets):
        """Pairs of bins that are looked at, in all steps."""
        frames = [spark.createDataFrame([r[1:] for r in rows], schema) for rows, schema in ((points, "_p0 double, _p1 double"), (targets, "_t0 double, _t1 double"))]
        area = N._Area([48.0, -139.0], [60.0, -114.0])
        return sum(step.count() for step in N.candidate_bins(*frames, area, 1, 0.0, N.MOST))

    even = [(f"t{i}", rnd.uniform(48, 60), rnd.uniform(-139, -114)) for i in range(20_000)]
    assert pairs(spot(20_000)) < 4 * len(points) and pairs(even) < 4 * len(points)


@pytest.mark.parametrize("k", [1, 3, 8])
def test_k_nearest_of_points_on_the_sphere(spark, k):
    rnd = random.Random(k)
    targets = [(i, 50 + rnd.gauss(0, 0.02), -120 + rnd.gauss(0, 0.02)) for i in range(400)] + [(1000 + i, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(200)]
    targets += [(2000 + i, 50.0, -120.0) for i in range(12)] + [(3000, None, 1.0)]
    points = [(i, rnd.uniform(-85, 85), rnd.uniform(-180, 180)) for i in range(100)] + [(200 + i, 50 + rnd.gauss(0, 0.02), -120.0) for i in range(60)] + [(500, 89.99, 0.0), (501, None, None)]
    at = sphere(F.col("lat"), F.col("lon"))
    frames = [spark.createDataFrame(rows, f"{c} long, lat double, lon double") for rows, c in ((points, "p"), (targets, "t"))]
    got = N.k_nearest(*frames, at, at, "t", k=k, most=20).collect()
    assert len(got) == len(points) - 1
    for r in got:
        want = sorted((km(r.lat, r.lon, y, x), t) for t, y, x in targets if y is not None)[:k]
        have = [2 * 6371 * math.asin(min(1.0, math.sqrt(n.d2) / (2 * 6371))) for n in r._near[:k]]
        assert have == pytest.approx([d for d, _ in want], abs=1e-4)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_nearest_random(spark, seed, n):
    rnd = random.Random(seed)
    targets = [(f"t{i}", round(rnd.uniform(48, 60), 2), round(rnd.uniform(-139, -114), 2)) for i in range(n)]
    points = [(f"p{i}", rnd.uniform(47, 61), rnd.uniform(-140, -113)) for i in range(60)]
    check(spark, points, targets)


def test_nearest_without_targets_or_coordinates(spark):
    points = spark.createDataFrame([("a", 50.0, -120.0), ("b", None, -120.0)], POINT)
    none = spark.createDataFrame([], TARGET)
    assert P.nearest(points, none, "p", "t").count() == 0
    some = spark.createDataFrame([("t", 50.0, -120.0)], TARGET)
    assert [r.p for r in P.nearest(points, some, "p", "t").collect()] == ["a"]


def km(a, b, c, d):
    s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(s))


@pytest.mark.parametrize("radius", [1.0, 10.0, 150.0])
def test_radius_equals_brute_force(spark, radius):
    rnd = random.Random(11)
    cells = [(f"c{i}", rnd.uniform(48, 60), rnd.uniform(-139, -114)) for i in range(80)]
    fires = [(i, c[1] + rnd.gauss(0, 0.1), c[2] + rnd.gauss(0, 0.2)) for i, c in enumerate(cells * 2)]
    fires += [(1000 + i, 50.0, -120.0) for i in range(80)]  # a third in one bin
    want = {(c, f) for c, a, b in cells for f, y, x in fires if km(a, b, y, x) <= radius}
    got = P.within_radius(
        spark.createDataFrame(cells, "cell_id string, lat double, lon double"), spark.createDataFrame(fires, "fire_id int, lat double, lon double"), radius
    )
    pairs = [(r.cell_id, r.fire_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_radius_reaches_over_the_pole_and_is_inclusive(spark):
    a = spark.createDataFrame([("c", 89.9, 0.0)], "cell_id string, lat double, lon double")
    b = spark.createDataFrame([(1, 89.9, 180.0), (2, 80.0, 0.0)], "fire_id int, lat double, lon double")
    assert [r.fire_id for r in P.within_radius(a, b, 30.0, bin_deg=1.0).collect()] == [1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_keeps_every_row(spark, how):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 7).cast("int").alias("k"))
    small = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "k int, v string")
    want = sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=str)
    got = sorted(map(tuple, skew.salted_join(big, small, ["k"], ["id"], how, rows_per_salt=50).select("id", "k", "v").collect()), key=str)
    assert got == want


def test_exclusion_zone(spark):
    cells = spark.createDataFrame([("a", 50.0, -120.0), ("b", 50.05, -120.0), ("c", 51.0, -120.0)], "cell_id string, lat double, lon double")
    fires = spark.createDataFrame([("a", "2020-06-10")], "cell_id string, d string").select("cell_id", F.col("d").cast("date").alias("date"))
    got = P.exclusion_zone(fires, cells)
    assert {r.cell_id for r in got.collect()} == {"a", "b"} and got.count() == 30


def test_fire_assignment_cap_and_dedup(spark):
    cells = spark.createDataFrame([("a", 50.0, -122.0), ("b", 51.0, -123.0)], "cell_id string, lat double, lon double")
    rows = [(1, 50.01, -122.0, "2020-07-01"), (2, 50.0, -122.01, "2020-07-01"), (3, 30.0, -100.0, "2020-07-01"), (4, None, -122.0, "2020-07-01")]
    fires = spark.createDataFrame(rows, "fire_id int, lat double, lon double, d string").withColumn("date", F.col("d").cast("date"))
    assert [(r.cell_id, str(r.date)) for r in P.assign_fires(fires, cells).collect()] == [("a", "2020-07-01")]
