import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from moisture import step
from pyspark.sql import functions as F

from emberlake.functions import fwi
from emberlake.operators import temporal as T

SCHEMA = "cell_id string, date date, temperature_c double, rh_pct double, wind_kmh double, precip_24h_mm double"


def _days(cells, n, seed, start=dt.date(2020, 1, 1)):
    rnd = random.Random(seed)
    return [
        (c, start + dt.timedelta(days=i), rnd.uniform(-15, 38), rnd.uniform(5, 100), rnd.uniform(0, 60), rnd.choice([0.0, 0.0, 0.0, rnd.uniform(0, 40)]))
        for c in cells
        for i in range(n)
    ]


def _loop(rows, reset):
    out = {}
    for cell in sorted({r[0] for r in rows}):
        state, span = (85.0, 6.0, 15.0), None
        for _, day, t, h, w, r in sorted(x for x in rows if x[0] == cell):
            here = {"season": day.year, "month": (day.year, day.month), "none": 0}[reset]
            if here != span:
                state, span = (85.0, 6.0, 15.0), here
            state = step(t, h, w, r, day.month, *state)
            out[cell, day] = state
    return out


@pytest.mark.parametrize("reset", ["season", "month", "none"])
def test_fold_equals_day_by_day_loop(spark, reset):
    rows = _days(["a", "b", "c"], 400, 7)
    random.Random(1).shuffle(rows)
    want = _loop(rows, reset)
    got = T.fold_codes(spark.createDataFrame(rows, SCHEMA), reset=reset).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.ffmc, r.dmc, r.dc) == pytest.approx(want[r.cell_id, r.date], rel=1e-9, abs=1e-9)
        assert 0 <= r.ffmc <= 101 and r.dmc >= 0 and r.dc >= 0 and r.isi >= 0 and r.bui >= 0 and r.fwi >= 0


def test_carried_state_equals_one_long_run(spark):
    rows = _days(["a", "b"], 60, 3)
    whole = spark.createDataFrame(rows, SCHEMA)
    cut = F.lit("2020-02-01").cast("date")
    first = T.fold_codes(whole.where(F.col("date") < cut), reset="none")
    second = T.fold_codes(whole.where(F.col("date") >= cut), reset="none", seed=T.final_state(first))
    want = {(r.cell_id, r.date): r.dc for r in T.fold_codes(whole, reset="none").collect()}
    for r in second.collect():
        assert r.dc == pytest.approx(want[r.cell_id, r.date])


def test_one_day_equals_fold_step(spark):
    rows = _days(["a", "b"], 1, 5)
    day = spark.createDataFrame(rows, SCHEMA)
    held = spark.createDataFrame([("a", 92.0, 100.0, 400.0)], "cell_id string, ffmc double, dmc double, dc double")
    got = {r.cell_id: r for r in T.one_day(day, held).collect()}
    for c, d, t, h, w, r in rows:
        before = (92.0, 100.0, 400.0) if c == "a" else (85.0, 6.0, 15.0)
        assert (got[c].ffmc, got[c].dmc, got[c].dc) == pytest.approx(step(t, h, w, r, d.month, *before))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.floats(-30, 45), st.floats(0, 100), st.floats(0, 120), st.floats(0, 150), st.integers(1, 12), st.floats(0, 101), st.floats(0, 300), st.floats(0, 900)),
        min_size=1,
        max_size=20,
    )
)
def test_columns_equal_plain_python(spark, rows):
    df = spark.createDataFrame([(i, *map(float, r[:4]), r[4], *map(float, r[5:])) for i, r in enumerate(rows)], "i int, t double, h double, w double, r double, m int, f double, p double, d double")
    t, h, w, r, m, f, p, d = (F.col(c) for c in "thwrmfpd")
    got = df.select("i", fwi.ffmc(t, h, w, r, f).alias("a"), fwi.dmc(t, h, r, p, m).alias("b"), fwi.dc(t, r, d, m).alias("c")).orderBy("i").collect()
    for row, g in zip(rows, got):
        assert (g.a, g.b, g.c) == pytest.approx(step(*row), rel=1e-7, abs=1e-7)


def test_extreme_and_wet_days(spark):
    rows = [("dry", dt.date(2020, 7, 1), 35.0, 10.0, 30.0, 0.0), ("wet", dt.date(2020, 7, 1), 15.0, 90.0, 5.0, 25.0)]
    held = spark.createDataFrame([("dry", 92.0, 100.0, 400.0), ("wet", 90.0, 50.0, 300.0)], "cell_id string, ffmc double, dmc double, dc double")
    got = {r.cell_id: r for r in T.one_day(spark.createDataFrame(rows, SCHEMA), held).collect()}
    assert got["dry"].fwi > 20 and got["wet"].ffmc < 90 and got["wet"].dmc < 50 and got["wet"].dc < 300


def test_forecast_stops_at_first_gap_and_decays(spark):
    days = [(1, k, 22.0, 45.0, 12.0, 225.0, 0.0, 2.0) for k in (1, 2, 4, 5)] + [(2, k, 22.0, None, 12.0, 225.0, 0.0, 2.0) for k in (2, 3)]
    schema = "wx_id int, lead_day int, temperature_c double, rh_pct double, wind_kmh double, wind_dir_deg double, precip_24h_mm double, evapotrans_mm double"
    df = spark.createDataFrame(days, schema).withColumns({f"soil_moisture_{i}": F.lit(None).cast("double") for i in range(1, 5)})
    got = T.forecast_roll(df, "2026-07-01", key="wx_id").orderBy("lead_day").collect()
    assert [(r.wx_id, r.lead_day) for r in got] == [(1, 1), (1, 2)]
    assert [r.confidence for r in got] == pytest.approx([0.95, 0.9025])
    assert got[0].soil_moisture_3 == 0.30 and str(got[1].valid_date) == "2026-07-03"


def test_diurnal_hours(spark):
    one = spark.range(1)
    at = lambda h: one.select(fwi.diurnal_ffmc(F.lit(85.0), F.lit(20.0), F.lit(40.0), h)).first()[0]
    assert at(14) == 95.0 and at(3) == 77.0
    with pytest.raises(ValueError):
        at(24)


def test_as_of_and_velocity(spark):
    d = lambda s: dt.date.fromisoformat(s)
    wanted = spark.createDataFrame([("a", d("2020-05-10")), ("b", d("2020-05-10"))], "cell_id string, date date")
    seen = spark.createDataFrame([("a", d("2020-05-03"), 1.0), ("a", d("2020-05-01"), 2.0), ("b", d("2020-05-02"), 3.0)], "cell_id string, date date, v double")
    got = {r.cell_id: (r.v, r.as_of) for r in T.as_of(wanted, seen, ["v"], 7, defaults={"v": -1.0}).collect()}
    assert got == {"a": (1.0, d("2020-05-03")), "b": (-1.0, None)}
    for n, v3, v7 in [(3, None, None), (4, 300.0, None), (7, 75.0, 600.0), (9, 50.0, 350.0)]:
        rows = [("a", d("2020-05-01") + dt.timedelta(days=2 * i), float(i + 1)) for i in range(n)]
        r = T.velocity(spark.createDataFrame(rows, "cell_id string, date date, score double")).first()
        assert (r.velocity_3day_pct, r.velocity_7day_pct, r.days_analyzed) == (v3, v7, n)
