import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlake.constants import LEVELS
from emberlake.functions import geo, score, weather
from emberlake.functions.base import safe_number


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("value,level", [(0.0, 0), (0.0499, 0), (0.05, 1), (0.15, 2), (0.35, 3), (0.5999, 3), (0.60, 4), (0.80, 5), (1.0, 5)])
def test_level_boundaries(spark, value, level):
    name = score.danger_level(F.lit(value))
    assert one(spark, name) == LEVELS[level]
    assert one(spark, score.danger_ordinal(name)) == level + 1


def test_level_is_monotone(spark):
    got = spark.range(0, 1001).select(score.danger_ordinal(score.danger_level(F.col("id") / 1000.0)).alias("o")).orderBy("id").collect()
    assert all(a.o <= b.o for a, b in zip(got, got[1:]))


def test_percentile_labels(spark):
    got = [one(spark, score.percentile_label(F.lit(p))) for p in (0, 19, 20, 40, 60, 80, 100)]
    assert got == ["WELL_BELOW_AVERAGE"] * 2 + ["BELOW_AVERAGE", "AVERAGE", "ABOVE_AVERAGE"] + ["WELL_ABOVE_AVERAGE"] * 2


def test_haines_bounds_and_missing(spark):
    h = lambda a, b, c: one(spark, weather.c_haines(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(c).cast("double")))
    assert h(20.0, -2.0, 19.0) == 0.0 and h(40.0, -40.0, 0.0) == 13.0
    assert h(None, 1.0, 1.0) is None


def test_distances(spark):
    km = lambda *a: one(spark, geo.haversine_km(*[F.lit(float(x)) for x in a]))
    assert km(50, -120, 50, -120) == 0
    assert 240 < km(49.2827, -123.1207, 50.6745, -120.3273) < 270
    assert 1.0 < km(50, -120, 50.01, -120) < 1.2
    assert 9900 < km(0, 0, 90, 0) < 10100


def test_safe_number(spark):
    for bad in ("nan", "inf", "-inf", "x", None):
        assert one(spark, safe_number(F.lit(bad).cast("string"), 7.0)) == 7.0
    assert one(spark, safe_number(F.lit("2.5"))) == 2.5


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(48, 61), st.floats(-140, -114)), min_size=1, max_size=30))
def test_projection_round_trip(spark, points):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lat double, lon double")
    x, y = geo.albers_forward(F.col("lat"), F.col("lon"))
    there = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = geo.albers_inverse(F.col("x"), F.col("y"))
    for r in there.select("lat", "lon", lat.alias("a"), lon.alias("b"), "x", "y").collect():
        assert abs(r.lat - r.a) < 1e-7 and abs(r.lon - r.b) < 1e-7
        assert geo.albers_point(r.lat, r.lon) == pytest.approx((r.x, r.y), abs=1e-4)


def test_projection_origin():
    assert geo.albers_point(45.0, -126.0) == pytest.approx((1_000_000.0, 0.0), abs=1e-6)


def test_composite_and_loss(spark):
    assert one(spark, score.composite(F.lit(50), F.lit(50), F.lit(0.5))) == pytest.approx(0.5)
    assert one(spark, score.annual_loss(F.lit(100000.0), F.lit(0.5), F.lit("high"), F.lit("IDF"))) == pytest.approx(17500.0)
    assert one(spark, score.annual_loss(F.lit(0.0), F.lit(0.5), F.lit("high"), F.lit("IDF"))) is None


def test_interval_is_ordered(spark):
    got = one(spark, score.interval(F.lit(1.4), F.lit(-0.2)))
    assert (got.lower, got.upper, got.level) == (0.0, 1.0, 0.9)


def test_summary_without_drivers(spark):
    none = F.array().cast("array<struct<feature:string,direction:string,description:string>>")
    assert one(spark, score.summary_text(none, F.lit("HIGH"))).endswith("Nothing is known about its causes.")


def test_boundary(spark):
    def inside(lat, lon):
        x, y = geo.albers_point(lat, lon)
        return one(spark, geo.inside_polygon(F.lit(x), F.lit(y), geo.boundary_xy()))

    assert inside(54, -125) and inside(49.5, -115)
    assert not inside(48.4, -118) and not inside(61, -125)
