"""Rows are moved once: the days of the streamed codes, the labels of training rows, points with wide circles."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from emberlake.functions.base import quick_bround
from emberlake.operators import spatial as P
from emberlake.operators.temporal import fold_codes
from emberlake.registry.catalog import queries
from emberlake.registry.domain import Domain
from emberlake.session import fresh_path
from emberlake.streaming import moisture


def _moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_days_of_a_batch_are_moved_once_and_not_copied(spark):
    first, schema = dt.date(2020, 5, 1), "cell_id string, date date, temperature_c double, rh_pct double, wind_kmh double, precip_24h_mm double"
    rows = [(c, first + dt.timedelta(days=d), 10.0 + d, 40.0 + d, 5.0, float(d % 4)) for c in ["a", "b", None] for d in range(12)] + [("a", None, 9.0, 50.0, 5.0, 0.0)]
    late, early = (spark.createDataFrame([r for r in rows if r[1] is None or (r[1] < first + dt.timedelta(days=6)) == k], schema).where("date IS NOT NULL OR %s" % k) for k in (False, True))
    root = fresh_path(spark, "codes")
    table = moisture.codes_table(root, buckets=2)
    readings = table.partial(late)
    assert _moves(moisture._rolled_on(None, readings)) == 1
    table(late, 0)
    table(early, 1)
    assert not os.path.exists(f"{root}/incoming") and "fwi" not in table.schema.names
    got = table.read(spark)
    assert got.count() == len(rows)
    daily = spark.createDataFrame([r for r in rows if r[0] and r[1]], schema)
    want = {(r.cell_id, r.date): (r.ffmc, r.dmc, r.dc, r.fwi) for r in fold_codes(daily, reset="none").where("cell_id = 'b'").collect()}
    assert {(r.cell_id, r.date): (r.ffmc, r.dmc, r.dc, r.fwi) for r in got.where("cell_id = 'b'").collect()} == want and len(want) == 12


def test_labels_come_with_their_weather(spark, tmp_path):
    queries()
    from emberlake.registry.learn import _label_rows, features

    at = lambda d: dt.datetime(2000, 3, 1 + d, d % 24)
    lines = [(i, i * 7, s, 1 + i % 7, 5.0 + i % 30, 0.01 * (i % 9), 0.01 * (i % 5), f, at(i % 9) if i % 11 else None) for i, (s, f) in enumerate([(1, "R"), (2, "A"), (None, "R"), (1, "N"), (2, None), (3, "R"), (1, "A")] * 9)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s,) for s in (1, 2, 3)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    d = Domain(spark, str(tmp_path))
    y = d.table("lineitem").groupBy(F.format_string("WX-%07d", "l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("date")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("fire"))
    got = _label_rows(d)
    want = features(d).join(y, ["cell_id", "date"]).select(got.columns)
    a, b = (sorted(map(str, df.collect())) for df in (got, want))
    assert a == b and len(a) > 15
    assert _moves(d.labelled_weather) == 1


def _km(a, b, c, d):
    s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(s))


@pytest.mark.parametrize("per_salt", [25_000, 3])
def test_points_with_wide_circles_are_moved_once(spark, monkeypatch, per_salt):
    monkeypatch.setattr(P, "POINTS_PER_SALT", per_salt)
    seen, join = [], P.salted_join
    monkeypatch.setattr(P, "salted_join", lambda big, *a, **k: (seen.append(big.count()), join(big, *a, **k))[1])
    rnd = random.Random(8)
    points = [(i, rnd.uniform(48, 60), rnd.uniform(-139, -114), r) for i, r in enumerate([1.0, 3.0, 15.9, 16.0, 16.1, 64.0, 100.0, 128.0, 255.0, 300.0, 499.0, 500.0] * 10)]
    points += [(500, None, -120.0, 20.0), (501, 50.0, -120.0, None), (502, 50.0, -120.0, 0.0), (503, -0.01, -60.0, 40.0), (504, 84.0, -60.0, 300.0)]
    fires = [(i, y + rnd.gauss(0, 0.3), x + rnd.gauss(0, 0.5)) for i, (_, y, x, _) in enumerate(points[:120] * 2)]
    fires += [(900, 50.0, -120.0), (901, None, -120.0), (902, 0.1, -59.9), (903, -0.2, -60.2), (904, 86.0, -30.0), (905, 84.0, -75.0)]
    want = {(p, f) for p, a, b, r in points for f, y, x in fires if None not in (a, r, y) and _km(a, b, y, x) <= r}
    got = P.within_radius(
        spark.createDataFrame(points, "cell_id long, lat double, lon double, radius_km double"), spark.createDataFrame(fires, "fire_id long, lat double, lon double"), F.col("radius_km"), split="points"
    )
    pairs = [(r.cell_id, r.fire_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and {503, 504} <= {p for p, _ in want}
    assert seen == [len(points) - 1]


def test_quick_rounding_equals_the_exact_one(spark):
    rnd = random.Random(2)
    values = [k / 20 + e for k in range(-400, 400) for e in (0.0, 1e-16, -1e-16, 1e-9, -1e-12)] + [rnd.uniform(0, 500) for _ in range(5000)]
    values += [rnd.choice([0.05, 0.25, 1.005, 3.35]) * rnd.randrange(1, 1000) for _ in range(2000)] + [1e15 / 3, 1e300, -0.0, 0.04, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~quick_bround(F.col("v"), 1).eqNullSafe(F.bround("v", 1))).count() == 0
