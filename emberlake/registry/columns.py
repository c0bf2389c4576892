"""Registered column functions: P01-P24 and M01-M32."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberlake import constants as K
from emberlake.functions import fwi as X
from emberlake.functions import geo as G
from emberlake.functions import score as C
from emberlake.functions import weather as W
from emberlake.functions.base import safe_number
from emberlake.operators import alerts as A
from emberlake.operators.raster import usable
from emberlake.operators.serving import history_slice, risk_grid
from emberlake.plans.daily import fill_features, prediction_record
from emberlake.plans.training import season
from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import DAY, NOW

hr, br = S.hr, S.br
ANOMALY = ["WELL_BELOW_NORMAL", "BELOW_NORMAL", "NEAR_NORMAL", "ABOVE_NORMAL", "WELL_ABOVE_NORMAL", "RECORD_HIGH"]
PCT = ["WELL_BELOW_AVERAGE", "BELOW_AVERAGE", "AVERAGE", "ABOVE_AVERAGE", "WELL_ABOVE_AVERAGE"]


@query("p01_danger_level", "history", f"SELECT cell_id, date::VARCHAR AS date, {S.level('score')} AS level FROM history")
def _(d):
    return d.history.select("cell_id", "date", C.danger_level(F.col("score")).alias("level"))


@query(
    "p02_danger_ordinal",
    "history",
    f"SELECT cell_id, date::VARCHAR AS date, list_position([{', '.join(repr(v) for v in K.LEVELS)}], {S.level('score')})::BIGINT AS ordinal FROM history",
)
def _(d):
    return d.history.select("cell_id", "date", C.danger_ordinal(C.danger_level(F.col("score"))).alias("ordinal"))


@query(
    "p03_danger_color",
    "history",
    f"SELECT cell_id, date::VARCHAR AS date, {S.case_map(K.LEVEL_COLORS, S.level('score'))} AS color FROM history",
)
def _(d):
    return d.history.select("cell_id", "date", C.danger_color(C.danger_level(F.col("score"))).alias("color"))


@query(
    "p04_safe_number",
    "",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN value ELSE -1 END::DOUBLE AS safe FROM events",
)
def _(d):
    e, v = F.col("event_id") % 5, F.col("value").cast("string")
    text = F.when(e == 0, "NaN").when(e == 1, "Infinity").when(e == 2, "n/a").when(e == 3, v)
    return d.table("events").select("event_id", safe_number(text, -1.0).alias("safe"))


_COVER = (
    f"CASE WHEN lat NOT BETWEEN {K.LAT_MIN}::DOUBLE AND {K.LAT_MAX}::DOUBLE THEN 'latitude outside coverage'"
    f" WHEN lon NOT BETWEEN {K.LON_MIN}::DOUBLE AND {K.LON_MAX}::DOUBLE THEN 'longitude outside coverage' END"
)


@query("p05_coverage_check", "locations", f"SELECT location_id, coalesce({_COVER}, 'ok') AS error FROM locations")
def _(d):
    return d.locations.select("location_id", F.coalesce(G.coverage_error(F.col("lat"), F.col("lon")), F.lit("ok")).alias("error"))


@query(
    "p06_area_filter",
    "scored_cells",
    "SELECT cell_id, lat, lon, score, level FROM (SELECT *, " + S.level("score") + " AS level FROM scored_cells)"
    " WHERE lat BETWEEN 49 AND 56.5::DOUBLE AND lon BETWEEN -128.25::DOUBLE AND -116 AND level = 'HIGH'",
)
def _(d):
    return risk_grid(d.scored_cells, "49.0,-128.25,56.5,-116.0", "high").select("cell_id", "lat", "lon", "score", "level")


@query(
    "p07_history_slice",
    "history",
    f"SELECT cell_id, date::VARCHAR AS date, score FROM history WHERE date BETWEEN DATE '{DAY}' - 90 AND DATE '{DAY}'",
)
def _(d):
    return history_slice(d.history, F.lit(DAY).cast("date"), 90)


@query("p08_season_filter", "weather", "SELECT cell_id, date::VARCHAR AS date FROM weather WHERE month(date) BETWEEN 4 AND 10")
def _(d):
    return season(d.weather).select("cell_id", "date")


@query("p09_zone_rule", "locations", f"SELECT location_id, {S.zone('lat', 'lon', 'z')} AS bec_zone FROM (SELECT *, CASE WHEN location_id % 7 = 0 THEN 0 ELSE location_id * 37 % 2600 END AS z FROM locations)")
def _(d):
    k = F.col("location_id")
    z = F.when(k % 14 == 0, F.lit(-32767.0)).when(k % 7 != 0, (k * 37 % 2600).cast("double"))
    return d.locations.select("location_id", C.zone_of(F.col("lat"), F.col("lon"), z).alias("bec_zone"))


@query("p10_fuel_type", "labels_t", f"SELECT bec_zone, {S.case_map(K.ZONE_FUEL, 'bec_zone')} AS fuel_type, count(*) AS rows FROM labels_t GROUP BY 1, 2")
def _(d):
    return d.labels.groupBy("bec_zone", C.fuel_of(F.col("bec_zone")).alias("fuel_type")).agg(F.count("*").alias("rows"))


@query("p11_zone_name", "labels_t", f"SELECT {S.case_map(K.ZONE_NAMES, 'bec_zone', 'bec_zone')} AS zone_name, count(*) AS rows FROM labels_t GROUP BY 1")
def _(d):
    return d.labels.groupBy(C.zone_name(F.col("bec_zone")).alias("zone_name")).agg(F.count("*").alias("rows"))


_CURVE = (
    "(CASE bec_zone "
    + " ".join(f"WHEN '{z}' THEN {S.by_month(v, 'month(date)')}" for z, v in K.SEASONAL_CURVES.items())
    + f" ELSE {S.by_month(K.SEASONAL_DEFAULT, 'month(date)')} END)"
)


@query(
    "p12_seasonal_curve",
    "labels_t",
    f"SELECT bec_zone, month(date) AS month, max({_CURVE}) AS risk_index, count(*) AS rows FROM labels_t GROUP BY 1, 2",
)
def _(d):
    index = C.seasonal_index(F.col("bec_zone"), F.month("date"))
    return d.labels.groupBy("bec_zone", F.month("date").alias("month")).agg(F.max(index).alias("risk_index"), F.count("*").alias("rows"))


@query(
    "p13_sentinel_filter",
    "",
    "SELECT event_id, value FROM events WHERE event_id % 4 = 3",
)
def _(d):
    e = F.col("event_id") % 4
    v = F.when(e == 0, F.lit(float("nan"))).when(e == 1, F.lit(float("-inf"))).when(e == 2, F.lit(-32767.0)).otherwise(F.col("value"))
    return d.table("events").select("event_id", v.alias("value")).where(usable(F.col("value")))


@query(
    "p14_feed_defaults",
    "weather",
    "SELECT cell_id, date::VARCHAR AS date, CASE WHEN day(date) % 2 = 0 THEN 15 ELSE "
    + hr("temperature_c", 6)
    + " END::DOUBLE AS temperature_c, CASE WHEN day(date) % 3 = 0 THEN 0.25 ELSE "
    + hr("soil_moisture_1", 6)
    + " END::DOUBLE AS soil_moisture_1 FROM weather",
)
def _(d):
    day = F.dayofmonth("date")
    gaps = d.weather.select(
        "cell_id",
        "date",
        F.when(day % 2 != 0, F.col("temperature_c")).alias("temperature_c"),
        F.when(day % 3 != 0, F.col("soil_moisture_1")).alias("soil_moisture_1"),
    )
    filled = gaps.fillna({c: v for c, v in K.FORECAST_FEED_DEFAULTS.items() if c in gaps.columns})
    return rounded(filled, {"temperature_c": 6, "soil_moisture_1": 6})


@query(
    "p15_feature_defaults",
    "weather",
    "SELECT cell_id, date::VARCHAR AS date, CASE WHEN day(date) % 2 = 0 THEN 50 ELSE " + hr("rh_pct", 6) + " END::DOUBLE AS rh_pct,"
    " 500::DOUBLE AS elevation_m, 128::DOUBLE AS hillshade, 85::DOUBLE AS ffmc, 0.5::DOUBLE AS ndvi, 50::DOUBLE AS distance_to_road_km FROM weather",
)
def _(d):
    gaps = d.weather.withColumn("rh_pct", F.when(F.dayofmonth("date") % 2 != 0, F.col("rh_pct")))
    full = fill_features(gaps, K.TRAINING_FEATURE_DEFAULTS)
    return rounded(full.select("cell_id", "date", "rh_pct", "elevation_m", "hillshade", "ffmc", "ndvi", "distance_to_road_km"), {"rh_pct": 6})


@query(
    "p16_stored_rounding",
    "weather",
    "SELECT cell_id, date::VARCHAR AS prediction_date, "
    + ", ".join(f"{br(c, n)} AS {c}" for c, n in [("temperature_c", 1), ("rh_pct", 1), ("wind_kmh", 1)])
    + f", {br('soil_moisture_1', 4)} AS soil_moisture FROM weather",
)
def _(d):
    day = fill_features(d.weather, K.TRAINING_FEATURE_DEFAULTS).withColumn("score", F.lit(0.5))
    return prediction_record(day).select("cell_id", "prediction_date", "temperature_c", "rh_pct", "wind_kmh", "soil_moisture")


@query("p17_anomaly_class", "history", f"SELECT cell_id, date::VARCHAR AS date, {S.steps('((score - 0.2) / 0.2 * 100)', [-20, 0, 50, 150, 300], ANOMALY)} AS status FROM history".replace("0.2)", "0.2::DOUBLE)").replace("/ 0.2 ", "/ 0.2::DOUBLE "))
def _(d):
    return d.history.select("cell_id", "date", C.anomaly_status(C.departure_pct(F.col("score"), F.lit(0.2))).alias("status"))


@query("p18_percentile_label", "history", f"SELECT cell_id, date::VARCHAR AS date, {S.steps('(score * 100)', [20, 40, 60, 80], PCT)} AS label FROM history")
def _(d):
    return d.history.select("cell_id", "date", C.percentile_label(F.col("score") * 100).alias("label"))


_HOST = "lower(regexp_extract(webhook_url, '^[a-z]+://([^/:?]+)', 1))"
_URL_ERR = (
    "CASE WHEN threshold NOT BETWEEN 0 AND 1 THEN 'threshold must be in [0, 1]' WHEN length(webhook_url) > 500 THEN 'url too long'"
    " WHEN NOT starts_with(webhook_url, 'https://') THEN 'must use https' WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0') THEN 'must not target localhost'"
    " WHEN regexp_matches(host, '^[0-9.]+$') AND (starts_with(host, '10.') OR starts_with(host, '192.168.') OR regexp_matches(host, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
    " THEN 'must not target private addresses' WHEN regexp_matches(host, '\\.(local|internal|corp|lan)$') THEN 'must not target internal domains' ELSE 'accepted' END"
)


@query(
    "p19_alert_validation",
    "requests",
    f"SELECT request_id, {_URL_ERR} AS verdict FROM (SELECT request_id, threshold * 1.1::DOUBLE AS threshold, webhook_url, {_HOST} AS host FROM requests)",
)
def _(d):
    reason = A.request_error(F.col("webhook_url"), F.col("threshold") * 1.1)
    return d.requests.select("request_id", F.coalesce(reason, F.lit("accepted")).alias("verdict"))


@query("p20_first_days", "node_weather", f"SELECT wx_id, lead_day::BIGINT AS lead_day, {hr('temperature_c', 6)} AS temperature_c FROM node_weather WHERE lead_day <= 3")
def _(d):
    return rounded(d.node_weather.where(F.col("lead_day") <= 3).select("wx_id", "lead_day", "temperature_c"), {"temperature_c": 6})


@query("p21_feature_subset", "weather", "SELECT cell_id, date::VARCHAR AS date, " + hr("rh_pct", 6) + " AS rh_pct, " + hr("wind_kmh", 6) + " AS wind_kmh FROM weather")
def _(d):
    names = [c for c in K.FEATURES if c in ("rh_pct", "wind_kmh")]
    return rounded(d.weather.select("cell_id", "date", *names), {c: 6 for c in names})


@query("p22_fire_years", "fires", "SELECT fire_id, year FROM fires WHERE year BETWEEN 1996 AND 1999")
def _(d):
    return d.fires.where(F.year("date").between(1996, 1999)).select("fire_id", "year")


@query("p23_retention", "history", f"SELECT cell_id, date::VARCHAR AS date, score FROM history WHERE date >= DATE '{DAY}' - 90")
def _(d):
    return A.retain(d.history, "date", F.lit(DAY).cast("date"), K.KEEP_PREDICTIONS_DAYS)


_STALE = f"is_active AND created_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND (last_triggered IS NULL OR last_triggered < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)"


@query(
    "p24_stale_alerts",
    "alerts",
    f"SELECT alert_id, (is_active AND NOT ({_STALE}))::BIGINT AS is_active, CASE WHEN {_STALE} THEN 'Auto-disabled: no successful delivery in 90 days' ELSE 'kept' END AS reason FROM alerts",
)
def _(d):
    out = A.disable_stale(d.alerts, F.lit(NOW).cast("timestamp"))
    return out.select("alert_id", "is_active", F.coalesce("disabled_reason", F.lit("kept")).alias("reason"))


# --- M ---------------------------------------------------------------------------------------------------


@query("m01_kelvin", "hourly", f"SELECT cell_id, ts::VARCHAR AS ts, {hr('temperature_k - 273.15::DOUBLE', 6)} AS celsius FROM hourly")
def _(d):
    return rounded(d.hourly.select("cell_id", "ts", W.kelvin_to_celsius(F.col("temperature_k")).alias("celsius")), {"celsius": 6})


_DEW = "(temperature_k - (rh_pct - 20) / 4.0::DOUBLE + 2)"
_MAG = lambda k: f"exp(17.625::DOUBLE * ({k} - 273.15::DOUBLE) / (243.04::DOUBLE + ({k} - 273.15::DOUBLE)))"


@query("m02_relative_humidity", "hourly", f"SELECT cell_id, ts::VARCHAR AS ts, {hr(S.clip(f'100 * {_MAG(_DEW)} / {_MAG('temperature_k')}', 0, 100), 6)} AS rh FROM hourly")
def _(d):
    dew = F.col("temperature_k") - (F.col("rh_pct") - 20) / 4.0 + 2
    return rounded(d.hourly.select("cell_id", "ts", W.relative_humidity(F.col("temperature_k"), dew).alias("rh")), {"rh": 6})


@query(
    "m03_wind_speed",
    "hourly",
    f"SELECT cell_id, ts::VARCHAR AS ts, {hr('sqrt(pow(wind_ms, 2) + pow(rh_pct / 10 - 5, 2)) * 3.6::DOUBLE', 6)} AS kmh FROM hourly",
)
def _(d):
    return rounded(d.hourly.select("cell_id", "ts", W.wind_speed_kmh(F.col("wind_ms"), F.col("rh_pct") / 10 - 5).alias("kmh")), {"kmh": 6})


@query(
    "m04_wind_direction",
    "hourly",
    f"SELECT cell_id, ts::VARCHAR AS ts, {hr('fmod(degrees(atan2(-(wind_ms - 7.05::DOUBLE), -(rh_pct / 10 - 5.03::DOUBLE))) + 360, 360)', 6)} AS deg FROM hourly",
)
def _(d):
    got = W.wind_direction(F.col("wind_ms") - 7.05, F.col("rh_pct") / 10 - 5.03)
    return rounded(d.hourly.select("cell_id", "ts", got.alias("deg")), {"deg": 6})


@query("m05_precipitation", "hourly", f"SELECT cell_id, ts::VARCHAR AS ts, {hr('CASE WHEN wind_ms < 3 THEN 0 ELSE greatest((precip_mm - 0.5::DOUBLE) / 1000.0::DOUBLE * 1000, 0) END', 6)} AS mm FROM hourly")
def _(d):
    metres = F.when(F.col("wind_ms") >= 3, (F.col("precip_mm") - 0.5) / 1000.0)
    return rounded(d.hourly.select("cell_id", "ts", W.precip_mm(metres).alias("mm")), {"mm": 6})


@query("m06_evapotranspiration", "hourly", f"SELECT cell_id, ts::VARCHAR AS ts, {hr('CASE WHEN wind_ms < 3 THEN 3 ELSE abs(-wind_ms / 1000.0::DOUBLE) * 1000 END', 6)} AS mm FROM hourly")
def _(d):
    metres = F.when(F.col("wind_ms") >= 3, -F.col("wind_ms") / 1000.0)
    return rounded(d.hourly.select("cell_id", "ts", W.evapotranspiration_mm(metres).alias("mm")), {"mm": 6})


@query(
    "m07_day_of_year",
    "weather",
    f"SELECT cell_id, date::VARCHAR AS date, {hr(f'sin(dayofyear(date) * {2 * math.pi!r}::DOUBLE / 365)', 6)} AS doy_sin, {hr(f'cos(dayofyear(date) * {2 * math.pi!r}::DOUBLE / 365)', 6)} AS doy_cos FROM weather",
)
def _(d):
    got = d.weather.select("cell_id", "date", W.doy_sin(F.col("date")).alias("doy_sin"), W.doy_cos(F.col("date")).alias("doy_cos"))
    return rounded(got, {"doy_sin": 6, "doy_cos": 6})


# One day of codes from varied previous codes.
_PREV = {"f0": "75 + day(date) * 0.8::DOUBLE", "p0": "month(date) * 7.5::DOUBLE", "d0": "day(date) * 20.0::DOUBLE"}
_DAYS = (
    "SELECT cell_id, date, temperature_c AS t, rh_pct AS h, wind_kmh AS w, precip_24h_mm AS r, month(date) AS mon, "
    + ", ".join(f"{e} AS {n}" for n, e in _PREV.items())
    + " FROM weather"
)
_ONE = S.with_spread(S.one_step(_DAYS, "cell_id, date, t, h, w"))


def _one_day(d):
    before = {"ffmc": F.dayofmonth("date") * 0.8 + 75, "dmc": F.month("date") * 7.5, "dc": F.dayofmonth("date") * 20.0}
    return X.day_columns(d.weather, before, F.month("date"))


def _code_query(name: str, code: str):
    @query(name, "weather", f"SELECT cell_id, date::VARCHAR AS date, {hr(code, 4)} AS {code} FROM ({_ONE})")
    def _(d):
        return rounded(_one_day(d).select("cell_id", "date", code), {code: 4})


for _name, _c in [("m08_ffmc", "ffmc"), ("m09_dmc", "dmc"), ("m10_dc", "dc"), ("m11_isi", "isi"), ("m12_bui", "bui"), ("m13_fwi", "fwi")]:
    _code_query(_name, _c)

_AMP = "greatest((1 + 0.03::DOUBLE * (t - 20)) * (1 + 0.012::DOUBLE * (40 - h)), 0.1::DOUBLE)"
_BASE = lambda hour: "[" + ", ".join(f"{v}::DOUBLE" for v in K.DIURNAL_BASE) + f"][({hour}) + 1]"


@query("m14_diurnal_ffmc", "weather", f"SELECT cell_id, date::VARCHAR AS date, {hr(S.clip(f'ffmc + {_BASE('day(date) % 24')} * {_AMP}', 0, 101), 4)} AS ffmc FROM ({_ONE})")
def _(d):
    got = X.diurnal_ffmc(F.col("ffmc"), F.col("temperature_c"), F.col("rh_pct"), F.dayofmonth("date") % 24)
    return rounded(_one_day(d).select("cell_id", "date", got.alias("ffmc")), {"ffmc": 4})


_ADJ = f"SELECT cell_id, date, w, bui, {S.clip(f'ffmc + {_BASE(14)} * {_AMP}', 0, 101)} AS ffmc FROM ({_ONE})"
_ADJ_ISI = f"SELECT *, {S.isi_sql('w', 'ffmc')} AS isi FROM ({_ADJ})"


@query(
    "m15_diurnal_propagation",
    "weather",
    f"SELECT cell_id, date::VARCHAR AS date, {hr('ffmc', 4)} AS ffmc, {hr('isi', 4)} AS isi, {hr('bui', 4)} AS bui, {hr(S.fwi_sql('isi', 'bui'), 4)} AS fwi FROM ({_ADJ_ISI})",
)
def _(d):
    got = X.apply_diurnal(_one_day(d), 14).select("cell_id", "date", "ffmc", "isi", "bui", "fwi")
    return rounded(got, {c: 4 for c in ("ffmc", "isi", "bui", "fwi")})


_HAINES = S.clip(S.clip("(t850 - t500 - 22) / 8", 0, 6) + " + " + S.clip("(t850 - td - 1) / 2.5::DOUBLE", 0, 7), 0, 13)


@query(
    "m16_c_haines",
    "hourly",
    f"SELECT cell_id, ts::VARCHAR AS ts, {hr(f'CASE WHEN t500 IS NULL THEN NULL ELSE {_HAINES} END', 6)} AS c_haines FROM (SELECT *, temperature_k - 273.15::DOUBLE AS t850,"
    " CASE WHEN precip_mm = 0 THEN -wind_ms * 2 - 10 END AS t500, temperature_k - 273.15::DOUBLE - rh_pct / 5 AS td FROM hourly)",
)
def _(d):
    t850 = F.col("temperature_k") - 273.15
    t500 = F.when(F.col("precip_mm") == 0, -F.col("wind_ms") * 2 - 10)
    got = W.c_haines(t850, t500, t850 - F.col("rh_pct") / 5)
    return rounded(d.hourly.select("cell_id", "ts", got.alias("c_haines")), {"c_haines": 6})


@query("m17_flame_length", "", f"SELECT event_id, {hr('CASE WHEN value > 20 THEN 0.0775::DOUBLE * pow((value - 20) * 50, 0.46::DOUBLE) ELSE 0 END', 6)} AS flame_m FROM events")
def _(d):
    return rounded(d.table("events").select("event_id", W.flame_length_m((F.col("value") - 20) * 50).alias("flame_m")), {"flame_m": 6})


@query(
    "m18_fire_type",
    "history",
    "SELECT cell_id, date::VARCHAR AS date, CASE WHEN score >= 0.9::DOUBLE THEN 'active_crown' WHEN score > 0.1::DOUBLE THEN 'intermittent_crown' ELSE 'surface' END AS fire_type FROM history",
)
def _(d):
    return d.history.select("cell_id", "date", W.fire_type(F.col("score")).alias("fire_type"))


@query(
    "m19_julian_day",
    "weather",
    "SELECT DISTINCT date::VARCHAR AS date, ([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][month(date)] + day(date))::BIGINT AS julian FROM weather",
)
def _(d):
    return d.weather.select("date", W.julian_day(F.col("date")).alias("julian")).distinct()


@query("m20_logit", "labels_t", f"SELECT row_a, row_b, row_c, {hr(S.logit('p'), 6)} AS logit, {hr(f'1 / (1 + exp(-({S.logit('p')} * 0.5::DOUBLE)))', 6)} AS sigmoid FROM labels_t")
def _(d):
    z = C.logit(F.col("p"))
    return rounded(d.labels.select("row_a", "row_b", "row_c", z.alias("logit"), C.sigmoid(z * 0.5).alias("sigmoid")), {"logit": 6, "sigmoid": 6})


@query("m21_haversine", "fires", f"SELECT fire_id, {hr(S.haversine('lat', 'lon', '49.2827::DOUBLE', '-123.1207::DOUBLE'), 6)} AS km FROM fires")
def _(d):
    return rounded(d.fires.select("fire_id", G.haversine_km(F.col("lat"), F.col("lon"), F.lit(49.2827), F.lit(-123.1207)).alias("km")), {"km": 6})


@query(
    "m22_planar_distance",
    "fires",
    f"SELECT fire_id, {hr(f'sqrt(pow((lat - 49.2827::DOUBLE) * 111, 2) + pow((lon + 123.1207::DOUBLE) * {G.KM_PER_DEG_LON!r}::DOUBLE, 2))', 6)} AS km FROM fires",
)
def _(d):
    return rounded(d.fires.select("fire_id", G.planar_km(F.col("lat"), F.col("lon"), F.lit(49.2827), F.lit(-123.1207)).alias("km")), {"km": 6})


@query(
    "m23_tile_of_point",
    "fires",
    f"SELECT fire_id, z, x, y, {hr('x / pow(2, z) * 360 - 180', 6)} AS west, {hr('degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z)))))', 6)} AS north FROM"
    " (SELECT fire_id, z, floor((lon + 180) / 360 * pow(2, z))::BIGINT AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z))::BIGINT AS y"
    " FROM (SELECT fire_id, lat, lon, 4 + fire_id % 9 AS z FROM fires))",
)
def _(d):
    z = F.col("z")
    got = d.fires.withColumn("z", F.col("fire_id") % 9 + 4).withColumns(
        {"x": F.floor(G.tile_x(F.col("lon"), z)), "y": F.floor(G.tile_y(F.col("lat"), z))}
    )
    return rounded(got.select("fire_id", "z", "x", "y", G.tile_west(F.col("x"), z).alias("west"), G.tile_north(F.col("y"), z).alias("north")), {"west": 6, "north": 6})


_BAND = lambda op: "1 + " + " + ".join(f"(score {op} {c}::DOUBLE)::INT" for c in K.LEVEL_CUTS)
_RGB = lambda i, op: "[" + ", ".join(str(rgb[i]) for rgb in K.LEVEL_RGB) + f"][{_BAND(op)}]::BIGINT"


@query(
    "m24_colours",
    "history",
    f"SELECT cell_id, date::VARCHAR AS date, {_RGB(0, '>=')} AS r, {_RGB(1, '>=')} AS g, {_RGB(2, '>=')} AS b, least(255, floor(50 + score * 205))::BIGINT AS a, {_RGB(0, '>')} AS heat_r FROM history",
)
def _(d):
    got = d.history.withColumns({"t": C.rgba(F.col("score"), "below"), "h": C.rgba(F.col("score"), "above")})
    return got.select("cell_id", "date", "t.r", "t.g", "t.b", "t.a", F.col("h.r").alias("heat_r"))


@query(
    "m25_pixel_index",
    "fires",
    f"SELECT fire_id, least(greatest(floor(({K.RASTER_LAT[1]}::DOUBLE - lat) / {(K.RASTER_LAT[1] - K.RASTER_LAT[0]) / K.RASTER_H!r}::DOUBLE), 0), 255)::BIGINT AS row,"
    f" least(greatest(floor((lon - {K.RASTER_LON[0]}::DOUBLE) / {(K.RASTER_LON[1] - K.RASTER_LON[0]) / K.RASTER_W!r}::DOUBLE), 0), 511)::BIGINT AS col FROM fires",
)
def _(d):
    return d.fires.select("fire_id", G.raster_row(F.col("lat")).alias("row"), G.raster_col(F.col("lon")).alias("col"))


_SIN = "sin(radians(lat))"
_Q = f"({1 - G._E2!r}::DOUBLE * ({_SIN} / (1 - {G._E2!r}::DOUBLE * {_SIN} * {_SIN}) - ln((1 - {G._E!r}::DOUBLE * {_SIN}) / (1 + {G._E!r}::DOUBLE * {_SIN})) / {2 * G._E!r}::DOUBLE))"
_RHO = f"({G._A}::DOUBLE * sqrt({G._C!r}::DOUBLE - {G._N!r}::DOUBLE * {_Q}) / {G._N!r}::DOUBLE)"
_THETA = f"({G._N!r}::DOUBLE * radians(lon + 126))"


@query(
    "m26_albers",
    "fires",
    f"SELECT fire_id, {hr(f'1000000 + {_RHO} * sin({_THETA})', 2)} AS x, {hr(f'{G._RHO0!r}::DOUBLE - {_RHO} * cos({_THETA})', 2)} AS y, {hr('lat', 6)} AS lat_back, {hr('lon', 6)} AS lon_back FROM fires",
)
def _(d):
    x, y = G.albers_forward(F.col("lat"), F.col("lon"))
    there = d.fires.select("fire_id", x.alias("x"), y.alias("y"))
    lat, lon = G.albers_inverse(F.col("x"), F.col("y"))
    return rounded(there.withColumns({"lat_back": lat, "lon_back": lon}), {"x": 2, "y": 2, "lat_back": 6, "lon_back": 6})


@query(
    "m27_heuristic_score",
    "weather",
    f"SELECT cell_id, date::VARCHAR AS date, {hr(S.heuristic('t', 's', 'w', 'wind_dir_deg / 9'), 6)} AS daily,"
    f" {hr(S.clip(f'0.5::DOUBLE * {S.clip("(t - 10) / 30.0::DOUBLE", 0, 1)} + 0.5::DOUBLE * {S.clip("wind_dir_deg / 9 / 40.0::DOUBLE", 0, 1)}', 0, 1), 6)} AS forecast"
    " FROM (SELECT *, temperature_c AS t, soil_moisture_1 AS s, wind_kmh AS w FROM weather)",
)
def _(d):
    t, f = F.col("temperature_c"), F.col("wind_dir_deg") / 9
    got = d.weather.select(
        "cell_id", "date", C.heuristic_score(t, F.col("soil_moisture_1"), F.col("wind_kmh"), f).alias("daily"), C.heuristic_forecast_score(t, f).alias("forecast")
    )
    return rounded(got, {"daily": 6, "forecast": 6})


@query(
    "m28_composite",
    "history",
    f"SELECT cell_id, date::VARCHAR AS date, {hr(S.clip('0.3::DOUBLE * (day(date) * 3) / 100 + 0.3::DOUBLE * (month(date) * 8) / 100 + 0.4::DOUBLE * score', 0, 1), 6)} AS composite FROM history",
)
def _(d):
    got = C.composite(F.dayofmonth("date") * 3, F.month("date") * 8, F.col("score"))
    return rounded(d.history.select("cell_id", "date", got.alias("composite")), {"composite": 6})


@query(
    "m29_departure",
    "history",
    f"SELECT cell_id, date::VARCHAR AS date, {hr('CASE WHEN day(date) % 4 > 0 THEN (score - day(date) % 4 * 0.1::DOUBLE) / nullif(day(date) % 4 * 0.1::DOUBLE, 0) * 100 WHEN score > 0 THEN score * 10000 ELSE 0 END', 5)} AS pct FROM history",
)
def _(d):
    base = F.dayofmonth("date") % 4 * 0.1
    return rounded(d.history.select("cell_id", "date", C.departure_pct(F.col("score"), base).alias("pct")), {"pct": 5})


@query(
    "m30_annual_loss",
    "scored_cells properties",
    "SELECT property_id, CASE WHEN value_cad > 0 THEN "
    + hr(
        f"value_cad * score * [0.15::DOUBLE, 0.35::DOUBLE, 0.60::DOUBLE][k % 3 + 1] * ({S.case_map(K.ZONE_SEASON_MONTHS, 'bec_zone', '5')} / 12.0::DOUBLE)", 2
    )
    + " END AS loss FROM properties JOIN scored_cells ON property_id = k",
)
def _(d):
    severity = F.element_at(F.array(F.lit("low"), F.lit("moderate"), F.lit("high")), (F.col("k") % 3).cast("int") + 1)
    joined = d.properties.select(F.col("property_id").alias("k"), "value_cad").join(d.scored_cells.select("k", "score", "bec_zone"), "k")
    return joined.select(F.col("k").alias("property_id"), C.annual_loss(F.col("value_cad"), F.col("score"), severity, F.col("bec_zone")).alias("loss"))


@query("m31_confidence", "node_weather", f"SELECT wx_id, lead_day::BIGINT AS lead_day, {hr('pow(0.95::DOUBLE, lead_day)', 6)} AS confidence FROM node_weather")
def _(d):
    return rounded(d.node_weather.select("wx_id", "lead_day", C.confidence(F.col("lead_day")).alias("confidence")), {"confidence": 6})


@query(
    "m32_interval",
    "labels_t",
    f"SELECT row_a, row_b, row_c, {br(f'least({S.clip("p - 0.2::DOUBLE", 0, 1)}, {S.clip("q + 0.15::DOUBLE", 0, 1)})', 4)} AS lower,"
    f" {br(f'greatest({S.clip("p - 0.2::DOUBLE", 0, 1)}, {S.clip("q + 0.15::DOUBLE", 0, 1)})', 4)} AS upper, 0.9::DOUBLE AS level FROM labels_t",
)
def _(d):
    got = d.labels.withColumn("ci", C.interval(F.col("p") - 0.2, F.col("q") + 0.15))
    return got.select("row_a", "row_b", "row_c", "ci.lower", "ci.upper", "ci.level")
