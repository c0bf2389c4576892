import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.constants import FEATURES
from emberlake.operators import alerts as A
from emberlake.operators import raster as R
from emberlake.operators import serving as V
from emberlake.plans.grid import build_grid
from emberlake.schemas import FEATURE_ROW
from emberlake.session import fresh_path
from emberlake.sources import readers as IN
from emberlake.sources import writers as OUT


@pytest.mark.parametrize(
    "url,ok",
    [
        ("https://hooks.example.com/a", True), ("https://8.8.8.8/x", True), ("https://172.32.0.1/x", True),
        ("http://hooks.example.com", False), ("https://localhost/x", False), ("https://127.9.9.9/", False), ("https://10.0.0.1/", False),
        ("https://192.168.1.1/", False), ("https://172.16.0.1/", False), ("https://169.254.1.1/", False), ("https://[::1]/", False),
        ("https://a.internal/x", False), ("https://x.corp", False), ("https://" + "a" * 500 + ".com", False), ("ftp://x.com", False), ("nonsense", False),
    ],
)
def test_webhook_urls(spark, url, ok):
    got = spark.range(1).select(A.request_error(F.lit(url), F.lit(0.5))).first()[0]
    assert (got is None) == ok


def test_alert_cap_holds_for_a_hot_key(spark):
    requests = spark.range(300).select(
        F.col("id").alias("request_id"), F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("api_key"), F.col("id").cast("string").alias("cell_id"), F.lit(0.5).alias("threshold"), F.lit("u").alias("webhook_url")
    )
    held = spark.range(4).select(F.lit(0).cast("bigint").alias("api_key"), F.col("id").cast("string").alias("cell_id"), F.lit(0.5).alias("threshold"), F.lit("u").alias("webhook_url"), F.lit(True).alias("is_active"))
    got = A.accept_requests(requests, held)
    assert got.where("api_key = 0").count() == 6 and got.where("api_key > 0").count() == 100
    assert sorted(r.request_id for r in got.where("api_key = 0").collect()) == [4, 5, 6, 7, 8, 9]


def test_heatmap_equals_mirrored_box_mean(spark):
    rnd = random.Random(8)
    cells = [(f"c{i:03d}", rnd.uniform(50, 51), rnd.uniform(-121, -119), rnd.random()) for i in range(40)]
    w, h = 80, 70
    got = R.heatmap(spark.createDataFrame(cells, "cell_id string, lat double, lon double, score double"), 50, -121, 51, -119, w, h)
    img, seen = np.zeros((h, w)), np.zeros((h, w))
    for _, lat, lon, s in sorted(cells):
        r, c = min(int((51 - lat) / (1 / h)), h - 1), min(int((lon + 121) / (2 / w)), w - 1)
        img[r, c], seen[r, c] = s, 1
    k = max(3, min(w, h) // 20)
    pad = lambda a: np.pad(a, ((k // 2, k - 1 - k // 2),) * 2, mode="symmetric")
    box = lambda a: np.array([[pad(a)[i : i + k, j : j + k].sum() for j in range(w)] for i in range(h)])
    num, den = box(img), box(seen)
    want = np.where(den > 0, num / np.where(den > 0, den, 1), 0)
    out = np.full((h, w), np.nan)
    for r in got.collect():
        out[r.row, r.col] = r.score
    assert np.allclose(out, want)


def test_terrain_equals_gradient(spark):
    z = np.random.default_rng(3).uniform(0, 2000, (6, 9))
    dem = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(6) for j in range(9)], "row int, col int, value double")
    dy, dx = np.gradient(z, 0.01 * 111000)
    slope = np.degrees(np.arctan(np.hypot(dx, dy)))
    for r in R.terrain(dem, 6, 9, 0.01).collect():
        assert r.slope_deg == pytest.approx(slope[r.row, r.col])
        assert r.aspect_deg == pytest.approx((np.degrees(np.arctan2(-dy, dx)) + 360)[r.row, r.col] % 360)
        assert 0 <= r.hillshade <= 255


def test_raster_sampling(spark):
    pixels = spark.createDataFrame([(0, 0, 1.0), (0, 1, -9.0), (1, 1, 4.0)], "row bigint, col bigint, value double")
    points = spark.createDataFrame([("a", 9.9, 0.1), ("b", 9.9, 1.5), ("c", 8.5, 1.5), ("d", 20.0, 0.0)], "id string, lat double, lon double")
    got = {r.id: r.value for r in R.sample(points, pixels, 10.0, 0.0, 1.0, nodata=-9.0).collect()}
    assert got == {"a": 1.0, "b": None, "c": 4.0, "d": None}


def test_grid_is_numbered_in_order_inside_the_boundary(spark):
    grid = build_grid(spark, 100.0)
    rows = grid.orderBy("cell_id").collect()
    assert [r.cell_id for r in rows] == [f"BC-100K-{i:07d}" for i in range(len(rows))]
    assert 130 < len(rows) < 250 and all(48.0 < r.lat < 60.5 and -140 < r.lon < -113 for r in rows)
    assert all((a.y, a.x) < (b.y, b.x) for a, b in zip(rows, rows[1:]))


def test_fire_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Lat,Long_x,rep_date,size\n50,-120,2020-07-01,\n51,-121,1999,5\n,-121,2001-01-01,1\n")
    a = IN.read_fire_csv(spark, str(tmp_path / "f.csv"))
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]]}
    doc = {"type": "FeatureCollection", "features": [{"geometry": shape, "properties": {"FIRE_YEAR": 2003, "SIZE_HA": 3.5, "FIRE_CAUSE": "Person"}}, {"geometry": None, "properties": {}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc))
    b = IN.perimeter_features(IN.read_features(spark, str(tmp_path / "p.geojson")))
    got = sorted((r.lat, r.lon, str(r.date), r.size_ha, r.cause or "") for r in IN.fire_history([a, b]).collect())
    assert got == [(1.0, 2.0, "2003-01-01", 3.5, "human"), (50.0, -120.0, "2020-07-01", 0.0, ""), (51.0, -121.0, "1999-01-01", 5.0, "")]
    doubled = IN.fire_history([a, a, b], dedupe=True)
    assert doubled.count() == 3


def test_payload_keeps_missing_values(spark):
    text = json.dumps({"daily": {"temperature_2m_max": [1.5, None, 3.0], "precipitation_sum": [0.0, 1.0]}})
    got = IN.forecast_payload(spark.createDataFrame([(7, text)], "wx_id int, payload string")).orderBy("lead_day").collect()
    assert [(r.lead_day, r.temperature_c, r.precip_24h_mm, r.rh_pct) for r in got] == [(0, 1.5, 0.0, None), (1, None, 1.0, None), (2, 3.0, None, None)]


def test_sinks_replace_only_their_partitions(spark):
    path = fresh_path(spark, "sink")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "cell_id string, v int, day string")
    OUT.overwrite_partitions(rows, path, ["day"])
    OUT.overwrite_partitions(rows.where("day = 'y'").withColumn("v", F.lit(2)), path, ["day"])
    assert sorted((r.cell_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    OUT.write_typed(rows.where("v > 9"), path + "-typed", FEATURE_ROW)
    assert spark.read.parquet(path + "-typed").columns == ["cell_id", "date", "lat", "lon", *FEATURES]


def test_top_drivers(spark):
    df = spark.createDataFrame([({"fwi": -0.5, "rh_pct": 0.2, "lai": 0.0}, {"fwi": 31.25, "rh_pct": 40.0})], "c map<string,double>, v map<string,double>")
    got = df.select(V.top_drivers(F.col("c"), F.col("v"), 2)).first()[0]
    assert [(d.feature, d.direction) for d in got] == [("fwi", "decreasing"), ("rh_pct", "increasing")]
    assert got[1].description == "air humidity of 40 percent"


def test_missing_prediction_is_an_error_row(spark):
    cells = spark.createDataFrame([("a", 50.0, -120.0, "IDF", "C3", 500.0), ("b", 55.0, -125.0, "SBS", "C2", 900.0)], "cell_id string, lat double, lon double, bec_zone string, fuel_type string, elevation_m double")
    asked = spark.createDataFrame([(1, 50.1, -120.1), (2, 55.1, -125.0), (3, 10.0, 10.0), (4, None, 1.0)], "location_id int, lat double, lon double")
    known = spark.createDataFrame([("a", 0.4)], "cell_id string, score double")
    got = {r.location_id: (r.cell_id, r.error) for r in V.star_lookup(V.locate(asked, cells, "location_id"), cells, known).collect()}
    assert got == {1: ("a", None), 2: ("b", "No prediction data available"), 3: (None, "latitude outside coverage"), 4: (None, "missing coordinate")}
