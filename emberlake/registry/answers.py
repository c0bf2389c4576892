"""Registered composite questions: Q00-Q18 and A26."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake import constants as K
from emberlake.functions.score import heuristic_score
from emberlake.operators import quality as Q
from emberlake.operators import serving as V
from emberlake.operators import spatial as P
from emberlake.operators import temporal as T
from emberlake.plans import answers as ANS
from emberlake.plans import daily as DAILY
from emberlake.plans import training as TRAIN
from emberlake.plans.grid import grid_from_points
from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import DAY, OBSERVED, cte
from emberlake.registry.joins import _CROSS, _ERR, _NODE, _RING, projected_sql
from emberlake.registry.learn import _label_rows
from emberlake.registry.windows import TREND_DAYS
from emberlake.session import materialize

hr, br = S.hr, S.br

cte("flagship", "stations weather season_rolled", f"SELECT bec_zone, {S.heuristic('temperature_c', 'soil_moisture_1', 'wind_kmh', 'fwi')} AS score FROM ({S.with_spread('SELECT r.*, x.temperature_c, x.soil_moisture_1, x.wind_kmh FROM season_rolled r JOIN weather x USING (cell_id, date) WHERE rn > 0')}) JOIN stations USING (cell_id)")


@query(
    "q00_risk_by_zone",
    "flagship",
    f"SELECT bec_zone, {S.case_map(K.ZONE_NAMES, 'bec_zone')} AS zone_name, {hr('avg(score)', 3)} AS avg_score, {hr('max(score)', 3)} AS max_score, {S.level('avg(score)')} AS level, count(*) AS cell_count, count(*) FILTER (score >= 0.6::DOUBLE) AS high_risk_cells FROM flagship GROUP BY 1",
)
def _(d):
    rolled = T.fold_codes(d.weather, carry=["soil_moisture_1"])
    scored = rolled.withColumn("score", heuristic_score(F.col("temperature_c"), F.col("soil_moisture_1"), F.col("wind_kmh"), F.col("fwi")))
    return V.zone_summary(scored.join(d.stations.select("cell_id", "bec_zone"), "cell_id"))


# --- daily risk: the last state before the day, then one step ------------------------------------------------
_D = f"DATE '{DAY}'"
cte("carried", "whole_rolled", f"SELECT cell_id, arg_max(ffmc, date) AS f0, arg_max(dmc, date) AS p0, arg_max(dc, date) AS d0 FROM whole_rolled WHERE rn > 0 AND date < {_D} GROUP BY 1")
_DEF = {c: K.DAILY_FEATURE_DEFAULTS[c] for c in OBSERVED}
cte(
    "today",
    "stations weather carried",
    "SELECT s.cell_id, s.bec_zone, s.elevation_m, h.as_of, coalesce(h.t, 0) AS t, coalesce(h.h, 50) AS h, coalesce(h.w, 10) AS w, coalesce(h.r, 0) AS r, coalesce(h.soil, 0.3) AS soil, coalesce(f0, 85) AS f0, coalesce(p0, 6) AS p0, coalesce(d0, 15) AS d0, 7 AS mon FROM stations s LEFT JOIN"
    f" (SELECT cell_id, max(date) AS as_of, arg_max(temperature_c, date) AS t, arg_max(rh_pct, date) AS h, arg_max(wind_kmh, date) AS w, arg_max(precip_24h_mm, date) AS r, arg_max(soil_moisture_1, date) AS soil FROM weather WHERE date BETWEEN {_D} - 7 AND {_D} GROUP BY 1) h USING (cell_id) LEFT JOIN carried USING (cell_id)",
)
_AMP = "greatest((1 + 0.03::DOUBLE * (t - 20)) * (1 + 0.012::DOUBLE * (40 - h)), 0.1::DOUBLE)"
_STEP = S.one_step("SELECT * FROM today", "cell_id, bec_zone, as_of, t, h, w, r, soil")
_HOUR = f"SELECT * EXCLUDE (ffmc), {S.clip(f'ffmc + {K.DIURNAL_BASE[14]}::DOUBLE * {_AMP}', 0, 101)} AS ffmc FROM ({_STEP})"
_RAW = f"SELECT *, {S.heuristic('t', 'soil', 'w', 'fwi')} AS raw FROM ({S.with_spread(_HOUR)})"
_W5 = S.case_map({z: v[0] for z, v in K.CALIBRATION_5KM.items()}, "bec_zone", "1.0::DOUBLE")
_B5 = S.case_map({z: v[1] for z, v in K.CALIBRATION_5KM.items()}, "bec_zone", "0.0::DOUBLE")
cte("daily", "today", f"SELECT *, 1 / (1 + exp(-({_W5} * {S.logit('raw')} + {_B5}))) AS score FROM ({_RAW})")


def daily(d):
    """The station records of one day, stepped from the stored codes of the whole history before it."""
    return DAILY.daily_risk(d.stations, d.weather, d.carried, DAY, calibration=K.CALIBRATION_5KM)


@query(
    "q01_daily_risk",
    "daily",
    f"SELECT cell_id, bec_zone, coalesce(as_of::VARCHAR, 'none') AS as_of, {hr('score', 4)} AS score, {S.level('score')} AS level, {hr('fwi', 1)} AS fwi, {hr('isi', 1)} AS isi FROM daily",
)
def _(d):
    got = daily(d)
    return got.select("cell_id", "bec_zone", F.coalesce(F.col("as_of").cast("string"), F.lit("none")).alias("as_of"), "score", "level", "fwi", "isi")


@query(
    "q01_daily_risk_of_cells",
    "daily cells stations",
    f"SELECT c.cell_id, m.id AS station_id, {hr('score', 4)} AS score FROM (SELECT c.cell_id, min({{'d2': pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2), 'id': s.cell_id}}) AS m FROM cells c CROSS JOIN stations s GROUP BY 1) c JOIN daily d ON d.cell_id = m.id",
)
def _(d):
    targets = d.stations.select(F.col("cell_id").alias("station_id"), "lat", "lon")
    near = P.nearest(d.cells.select("cell_id", "lat", "lon"), targets, "cell_id", "station_id").select("cell_id", "station_id")
    return near.join(daily(d).select(F.col("cell_id").alias("station_id"), "score"), "station_id")


@query(
    "q02_forecast",
    "cells forecast_scored",
    f"SELECT c.cell_id, rn AS lead_day, {hr('risk', 4)} AS risk_score, {S.level('risk')} AS danger_label, {br('fwi', 2)} AS fwi, CASE WHEN rn <= 2 THEN 'GEM' ELSE 'GEM_GLOBAL' END AS data_source FROM (SELECT cell_id, ({_NODE})::BIGINT AS wx_id FROM cells) c JOIN forecast_scored f ON f.cell_id = c.wx_id",
)
def _(d):
    return DAILY.forecast(d.cells, d.node_weather, "2001-06-26").select("cell_id", "lead_day", "risk_score", "danger_label", "fwi", "data_source")


@query(
    "q03_fire_statistics",
    "stats",
    f"SELECT cell_id, n10, n30, nall, {hr('near_all', 6)} AS nearest_km, {hr('susceptibility_score', 9)} AS susceptibility_score, susceptibility_basis, susceptibility_percentile, exposure_percentile, {hr('mean_return_years', 5)} AS mean_return_years, typical_severity, dominant_cause FROM stats",
)
def _(d):
    return d.statistics().select(
        "cell_id",
        F.col("fires_10yr.count").alias("n10"),
        F.col("fires_30yr.count").alias("n30"),
        F.col("fires_all.count").alias("nall"),
        F.round("fires_all.nearest_km", 6).alias("nearest_km"),
        F.round("susceptibility_score", 9).alias("susceptibility_score"),
        "susceptibility_basis",
        "susceptibility_percentile",
        "exposure_percentile",
        F.round("mean_return_years", 5).alias("mean_return_years"),
        "typical_severity",
        "dominant_cause",
    )


_COMP = S.clip("0.3::DOUBLE * susceptibility_percentile / 100 + 0.3::DOUBLE * exposure_percentile / 100 + 0.4::DOUBLE * score", 0, 1)


@query(
    "q04_risk_profile",
    "locations location_cell stats predictions",
    f"SELECT location_id, cell_id, error, CASE WHEN error = 'ok' THEN {hr('comp', 6)} END AS composite_score, CASE WHEN error = 'ok' THEN {S.level('comp')} END AS composite_level, bec_zone, typical_severity, n10::DOUBLE AS fires_10yr FROM"
    f" (SELECT *, {_ERR} AS error, {_COMP} AS comp FROM (SELECT l.*, m.cell_id, s.bec_zone, s.typical_severity, s.n10, s.susceptibility_percentile, s.exposure_percentile, p.score FROM locations l LEFT JOIN location_cell m USING (location_id) LEFT JOIN stats s USING (cell_id) LEFT JOIN predictions p USING (cell_id)))",
)
def _(d):
    forecast = DAILY.forecast(d.cells, d.node_weather, "2001-06-26")
    got = ANS.risk_profile(d.locations, d.cells, d.predictions.drop("date"), d.stats, forecast)
    out = got.select("location_id", "cell_id", F.coalesce("error", F.lit("ok")).alias("error"), "composite_score", "composite_level", "bec_zone", "typical_severity", F.col("fires_10yr.count").cast("double").alias("fires_10yr"))
    return rounded(out, {"composite_score": 6})


cte(
    "cell_forecast",
    "cells forecast_scored",
    f"SELECT c.cell_id, rn AS lead_day, {hr('risk', 4)} AS risk_score, {S.level('risk')} AS danger_label FROM (SELECT cell_id, ({_NODE})::BIGINT AS wx_id FROM cells) c JOIN forecast_scored f ON f.cell_id = c.wx_id",
)


@query(
    "q04_forecast_snippet",
    "locations location_cell cell_forecast",
    "SELECT location_id, m.cell_id, lead_day, risk_score, danger_label FROM locations JOIN location_cell m USING (location_id) JOIN cell_forecast f ON f.cell_id = m.cell_id WHERE lead_day <= 3",
)
def _(d):
    forecast = DAILY.forecast(d.cells, d.node_weather, "2001-06-26")
    got = ANS.risk_profile(d.locations, d.cells, d.predictions.drop("date"), d.stats, forecast)
    return got.select("location_id", "cell_id", F.inline("forecast_snippet")).drop("valid_date")


_LOSS = (
    f"CASE WHEN value_cad > 0 THEN value_cad * comp * {S.case_map(K.SEVERITY_FACTORS, 'typical_severity')} * ({S.case_map(K.ZONE_SEASON_MONTHS, 'bec_zone', '5')} / 12.0::DOUBLE) END"
)
cte(
    "assessed",
    "properties property_cell stats predictions",
    f"SELECT *, {hr(_LOSS, 2)} AS loss, {S.level('comp')} AS composite_level FROM (SELECT *, {_ERR} AS error, {_COMP} AS comp FROM (SELECT l.*, m.cell_id, s.bec_zone, s.typical_severity, s.susceptibility_percentile, s.exposure_percentile, p.score"
    " FROM properties l LEFT JOIN property_cell m USING (property_id) LEFT JOIN stats s USING (cell_id) LEFT JOIN predictions p USING (cell_id)))",
)


def assessed(d):
    return materialize(V.portfolio(d.properties, d.cells, d.predictions.drop("date"), d.stats), "portfolio")


@query(
    "q05_portfolio",
    "assessed",
    f"SELECT property_id, cell_id, error, CASE WHEN error = 'ok' THEN {hr('comp', 6)} END AS composite_score, CASE WHEN error = 'ok' THEN composite_level END AS composite_level, CASE WHEN error = 'ok' THEN {hr('loss + 1e-7', 2)} END AS loss FROM assessed",
)
def _(d):
    got = V.portfolio(d.properties, d.cells, d.predictions.drop("date"), d.stats)
    out = got.select("property_id", "cell_id", F.coalesce("error", F.lit("ok")).alias("error"), "composite_score", "composite_level", (F.col("estimated_annual_loss_cad") + 1e-7).alias("loss"))
    return rounded(out, {"composite_score": 6, "loss": 2})


@query(
    "q05_portfolio_with_forecast",
    "properties property_cell cell_forecast",
    "SELECT property_id, m.cell_id, nullif(max(CASE WHEN lead_day <= 3 THEN risk_score END), 0) AS forecast_3day_max FROM properties LEFT JOIN property_cell m USING (property_id) LEFT JOIN cell_forecast f ON f.cell_id = m.cell_id GROUP BY 1, 2",
)
def _(d):
    forecast = DAILY.forecast(d.cells, d.node_weather, "2001-06-26")
    got = V.portfolio(d.properties, d.cells, d.predictions.drop("date"), d.stats, forecast)
    return got.select("property_id", "cell_id", "forecast_3day_max")


@query(
    "a26_portfolio_summary",
    "assessed",
    f"SELECT coalesce(bec_zone, 'all') AS zone, coalesce(composite_level, 'all') AS level, count(*) AS properties, {hr('avg(comp)', 6)} AS mean_composite, {hr('max(comp)', 6)} AS max_composite, {hr('sum(coalesce(value_cad, 0)) + 1e-5', 1)} AS insured_value FROM assessed WHERE error = 'ok'"
    " GROUP BY GROUPING SETS ((), (bec_zone), (composite_level), (bec_zone, composite_level))",
)
def _(d):
    got = V.portfolio_summary(assessed(d))
    out = got.select(
        F.coalesce("bec_zone", F.lit("all")).alias("zone"), F.coalesce("composite_level", F.lit("all")).alias("level"), "properties", "mean_composite", "max_composite", (F.col("insured_value") + 1e-5).alias("insured_value")
    )
    return rounded(out, {"mean_composite": 6, "max_composite": 6, "insured_value": 1})


@query(
    "a26_level_distribution",
    "assessed",
    f"SELECT l.i AS ordinal, l.lvl AS composite_level, coalesce(n, 0) AS properties, {hr('v + 1e-5', 1)} AS value_at_risk FROM (SELECT unnest(range(1, 7)) AS i, unnest([{', '.join(repr(v) for v in K.LEVELS)}]) AS lvl) l LEFT JOIN"
    " (SELECT composite_level AS lvl, count(*) AS n, sum(CASE WHEN value_cad > 0 THEN value_cad END) AS v FROM assessed WHERE error = 'ok' GROUP BY 1) USING (lvl)",
)
def _(d):
    got = V.level_distribution(assessed(d)).withColumn("value_at_risk", F.col("value_at_risk") + 1e-5)
    return rounded(got, {"value_at_risk": 1})


_PCT = "(CASE WHEN s > 0 THEN (score - s) / s * 100 WHEN score > 0 THEN score * 10000 ELSE 0 END)"
_ANOM = ["WELL_BELOW_NORMAL", "BELOW_NORMAL", "NEAR_NORMAL", "ABOVE_NORMAL", "WELL_ABOVE_NORMAL", "RECORD_HIGH"]


def _trend_sql(velocities: str) -> str:
    return (
        f"SELECT location_id, cell_id, CASE WHEN score IS NOT NULL THEN {S.steps(_PCT, [-20, 0, 50, 150, 300], _ANOM)} END AS status, coalesce(days_analyzed, 0) AS days_analyzed, v3 AS velocity_3day_pct, v7 AS velocity_7day_pct FROM"
        f" (SELECT l.location_id, m.cell_id, p.score, coalesce(s.susceptibility_score, 0) AS s, v.days_analyzed, v3, v7 FROM locations l LEFT JOIN location_cell m USING (location_id) LEFT JOIN stats s USING (cell_id) LEFT JOIN predictions p USING (cell_id) LEFT JOIN {velocities} v USING (cell_id))"
    )


def _trend_rows(got):
    return got.select("location_id", "cell_id", "status", "days_analyzed", "velocity_3day_pct", "velocity_7day_pct")


@query("q06_trends", "locations location_cell stats predictions velocities", _trend_sql("velocities"))
def _(d):
    return _trend_rows(ANS.trends(d.locations, d.cells, d.predictions.drop("date"), d.stats, d.history))


@query("q06_trends_of_days", "locations location_cell stats predictions recent_velocities", _trend_sql("recent_velocities"))
def _(d):
    return _trend_rows(ANS.trends(d.locations, d.cells, d.predictions.drop("date"), d.stats, d.history, DAY, TREND_DAYS))


@query(
    "q07_zones_today",
    "daily",
    f"SELECT bec_zone, {hr('avg(s)', 3)} AS avg_score, {hr('max(s)', 3)} AS max_score, count(*) AS cell_count FROM (SELECT bec_zone, {hr('score', 4)} AS s FROM daily) GROUP BY 1",
)
def _(d):
    return V.zone_summary(daily(d)).select("bec_zone", "avg_score", "max_score", "cell_count")


@query(
    "q08_risk_grid",
    "scored_cells",
    f"SELECT cell_id, lat, lon, score, {S.level('score')} AS level, {S.case_map(K.LEVEL_COLORS, S.level('score'))} AS color FROM scored_cells WHERE lat BETWEEN {K.LAT_MIN}::DOUBLE AND {K.LAT_MAX}::DOUBLE AND lon BETWEEN {K.LON_MIN}::DOUBLE AND {K.LON_MAX}::DOUBLE",
)
def _(d):
    return V.risk_grid(d.scored_cells, f"{K.LAT_MIN},{K.LON_MIN},{K.LAT_MAX},{K.LON_MAX}").select("cell_id", "lat", "lon", "score", "level", "color")


@query("q09_tile_counts", "tile_hits", "SELECT z, x, y, count(DISTINCT cell_id) AS cells FROM tile_hits WHERE lat BETWEEN s AND n AND lon BETWEEN west AND east GROUP BY 1, 2, 3")
def _(d):
    # painted with one pixel per cell, counted per tile
    keyed = d.scored_cells.withColumn("score", F.col("k").cast("double"))
    z = F.explode(F.array(*[F.lit(v) for v in (4, 5, 6, 7)])).alias("z")
    from emberlake.functions.geo import tile_north, tile_west, tile_x, tile_y

    rows = keyed.select("cell_id", "lat", "lon", z)
    fx = tile_x(F.col("lon"), F.col("z"))
    rows = rows.withColumn("x", F.explode(F.array_distinct(F.array(F.ceil(fx) - 1, F.floor(fx))))).withColumn("y", F.floor(tile_y(F.col("lat"), F.col("z"))))
    inside = F.col("lat").between(tile_north(F.col("y") + 1, F.col("z")), tile_north(F.col("y"), F.col("z"))) & F.col("lon").between(
        tile_west(F.col("x"), F.col("z")), tile_west(F.col("x") + 1, F.col("z"))
    )
    return rows.where(inside).groupBy("z", "x", "y").agg(F.count_distinct("cell_id").alias("cells"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(c) DESC, feature) AS rank FROM contribution_rows"


@query(
    "q10_explain",
    "locations location_cell contribution_rows",
    f"SELECT location_id, m.cell_id, r.rank, r.feature, {br('r.c', 6)} AS contribution FROM locations JOIN location_cell m USING (location_id) JOIN ({_RANKED}) r ON r.cell_id = m.cell_id WHERE r.rank <= 5",
)
def _(d):
    explained = d.explained.select("cell_id", "score", "contributions", "feature_values")
    got = ANS.explain(d.locations, d.cells, explained, 5).where(F.col("error").isNull())
    rows = got.select("location_id", "cell_id", F.posexplode("drivers").alias("i", "x"))
    return rows.select("location_id", "cell_id", (F.col("i") + 1).alias("rank"), "x.feature", "x.contribution")


@query(
    "q11_history",
    "locations location_cell history",
    f"SELECT location_id, m.cell_id, h.date::VARCHAR AS date, h.score, {br('h.score - y.score', 4)} AS change_24h FROM locations JOIN location_cell m USING (location_id) JOIN history h ON h.cell_id = m.cell_id AND h.date BETWEEN {_D} - 90 AND {_D} LEFT JOIN history y ON y.cell_id = h.cell_id AND y.date = h.date - 1",
)
def _(d):
    return ANS.history(d.locations, d.cells, d.history, DAY, 90)


@query(
    "q12_batch_risk",
    "locations location_cell cells predictions",
    f"SELECT location_id, cell_id, error, bec_zone, CASE WHEN error = 'ok' THEN score END AS score, CASE WHEN error = 'ok' THEN {S.level('score')} END AS level FROM (SELECT *, {_ERR} AS error FROM (SELECT l.*, m.cell_id, c.bec_zone, p.score FROM locations l LEFT JOIN location_cell m USING (location_id) LEFT JOIN cells c USING (cell_id) LEFT JOIN predictions p USING (cell_id)))",
)
def _(d):
    got = ANS.batch_risk(d.locations, d.cells, d.predictions.drop("date"))
    return got.select("location_id", "cell_id", F.coalesce("error", F.lit("ok")).alias("error"), "bec_zone", "score", "level")


@query(
    "q13_fires_near",
    "properties active_fires",
    f"SELECT property_id AS location_id, fire_id, {br('km', 1)} AS distance_km, size_ha FROM (SELECT l.property_id, f.fire_id, f.size_ha, 1 + (property_id * 7) % 500 AS radius_km, {S.haversine('l.lat', 'l.lon', 'f.lat', 'f.lon')} AS km FROM properties l CROSS JOIN active_fires f) WHERE km <= radius_km",
)
def _(d):
    points = d.properties.select(F.col("property_id").alias("location_id"), "lat", "lon", (F.col("property_id") * 7 % 500 + 1).cast("double").alias("radius_km"))
    return ANS.fires_near(points, d.active_fires).select("location_id", "fire_id", "distance_km", "size_ha")


_GX, _GY = (f"{min(p[i] for p in _RING)!r}::DOUBLE" for i in (0, 1))
cte(
    "lattice",
    "cells",
    f"SELECT row, col, points, elevation, col * 25000 + ({_GX} + 12500) AS x, row * 25000 + ({_GY} + 12500) AS y FROM (SELECT floor((y - {_GY}) / 25000)::BIGINT AS row, floor((x - {_GX}) / 25000)::BIGINT AS col, count(*) AS points, avg(elevation_m) AS elevation FROM ({projected_sql('SELECT * FROM cells')}) GROUP BY 1, 2)",
)


@query(
    "q14_grid_from_points",
    "lattice",
    f"SELECT row, col, 'BC-25K-' || lpad((row_number() OVER (ORDER BY row, col) - 1)::VARCHAR, 7, '0') AS cell_id, points, {hr('elevation', 6)} AS elevation_m FROM lattice WHERE ({_CROSS}) % 2 = 1",
)
def _(d):
    got = grid_from_points(d.cells.select("lat", "lon", "elevation_m"), 25.0)
    return rounded(got.select("row", "col", "cell_id", "points", "elevation_m"), {"elevation_m": 6})


@query("q15_process_period", "weather", "SELECT cell_id, date::VARCHAR AS date, " + hr("temperature_c", 6) + " AS temperature_c, 28::DOUBLE AS features FROM weather WHERE month(date) BETWEEN 4 AND 10")
def _(d):
    steps = d.physical(d.steps.select("cell_id", "ts", "q_t", "q_h", "q_w", "q_d", "q_r", "q_e", "q_s"))
    got = TRAIN.process_period(steps, d.stations)
    wide = F.lit(float(len([c for c in K.FEATURES if c in got.columns])))
    return rounded(got.select("cell_id", "date", "temperature_c", wide.alias("features")), {"temperature_c": 6})


@query("q15_train_and_test")
def _(d):
    from emberlake.ml.train import train_and_test

    _, _, tested = train_and_test(_label_rows(d), K.FEATURES, ["cell_id", "date"])
    return tested.drop("thresholds")


@query("q16_zone_report", "eval_zone", f"SELECT bec_zone, {hr('auc_roc', 6)} AS auc_roc, {hr('brier_score', 6)} AS brier_score, n_samples, n_positive FROM eval_zone WHERE n_samples >= 50 AND n_positive > 0 AND n_positive < n_samples")
def _(d):
    got = TRAIN.zone_report(d.labels).select("bec_zone", "auc_roc", "brier_score", "n_samples", "n_positive")
    return rounded(got, {"auc_roc": 6, "brier_score": 6})


@query("q17_data_quality", "found_months", "SELECT year(month_start) AS year, count(*) AS months, sum(rows)::BIGINT AS rows, count(*) FILTER (rows < 600) AS too_small FROM found_months GROUP BY 1")
def _(d):
    found = d.steps.groupBy(F.trunc(F.to_date("ts"), "month").alias("month_start")).agg(F.count(F.lit(1)).alias("rows"))
    return found.groupBy(F.year("month_start").alias("year")).agg(F.count(F.lit(1)).alias("months"), F.sum("rows").alias("rows"), F.count_if(F.col("rows") < 600).alias("too_small"))


@query(
    "q18_status",
    "cells predictions runs",
    "SELECT CASE WHEN p.n > 0 THEN 'operational' ELSE 'initializing' END AS status, p.n > 0 AS pipeline_healthy, c.n AS grid_cells, r.run_id AS last_run, r.status AS last_status, r.started_at::VARCHAR AS last_pipeline_run"
    " FROM (SELECT count(*) AS n FROM cells) c, (SELECT count(*) AS n FROM predictions) p, (SELECT * FROM runs WHERE status <> 'O' ORDER BY started_at DESC, run_id DESC LIMIT 1) r",
)
def _(d):
    return Q.status(d.cells, d.predictions, d.runs, finished=["F", "P"])


@query(
    "q18_coverage",
    "cells predictions",
    "SELECT count(*) AS cells, count(p.cell_id) AS predicted_cells, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, count(DISTINCT bec_zone) AS zones FROM cells c LEFT JOIN predictions p USING (cell_id)".replace("count(p.cell_id)", "count(p.score)"),
)
def _(d):
    return Q.coverage(d.cells, d.predictions)


