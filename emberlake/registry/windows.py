"""Registered windows, recurrences, sorts and sets: W01-W15, L01-L08, E01-E04."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberlake import constants as K
from emberlake.operators import alerts as A
from emberlake.operators import firestats as FS
from emberlake.operators import raster as R
from emberlake.operators import sampling as N
from emberlake.operators import serving as V
from emberlake.operators import spatial as P
from emberlake.operators import temporal as T
from emberlake.plans.answers import nearest_fires
from emberlake.plans.grid import number_cells
from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import DAY, NOW, cte
from emberlake.registry.joins import due
from emberlake.sources.readers import fire_history

hr, br = S.hr, S.br


# --- the ordered recurrence as a recursive query ------------------------------------------------------------


def fold_ctes(name: str, group: str) -> None:
    """``<name>_rolled``: codes of every station day, restarted per ``group``."""
    cte(
        f"{name}_days",
        "weather",
        "SELECT cell_id, date, temperature_c AS t, rh_pct AS h, wind_kmh AS w, precip_24h_mm AS r, month(date) AS mon,"
        f" {group} AS grp, row_number() OVER (PARTITION BY cell_id, {group} ORDER BY date) AS rn FROM weather",
    )
    seed = f"SELECT cell_id, grp, 0::BIGINT AS rn, NULL::DATE AS date, 0.0::DOUBLE AS w, 85.0::DOUBLE AS ffmc, 6.0::DOUBLE AS dmc, 15.0::DOUBLE AS dc FROM {name}_days GROUP BY 1, 2"
    source = f"SELECT n.*, p.ffmc AS f0, p.dmc AS p0, p.dc AS d0 FROM {name}_rolled p JOIN {name}_days n ON n.cell_id = p.cell_id AND n.grp = p.grp AND n.rn = p.rn + 1"
    cte(f"{name}_rolled", f"{name}_days", f"({seed}) UNION ALL ({S.one_step(source, 'cell_id, grp, rn, date, w')})")


fold_ctes("season", "year(date)")
fold_ctes("month", "year(date) * 100 + month(date)")
fold_ctes("whole", "0")
_CODES = ", ".join(f"{hr(c, 4)} AS {c}" for c in K.CODES)


def _fold_query(name: str, table: str, reset: str):
    @query(name, table, f"SELECT cell_id, date::VARCHAR AS date, {_CODES} FROM ({S.with_spread(f'SELECT * FROM {table} WHERE rn > 0')})")
    def _(d):
        return rounded(T.fold_codes(d.weather, reset=reset).select("cell_id", "date", *K.CODES), {c: 4 for c in K.CODES})


_fold_query("w01_codes_season_reset", "season_rolled", "season")
_fold_query("w01_codes_month_reset", "month_rolled", "month")
_fold_query("w01_codes_continuous", "whole_rolled", "none")


@query(
    "w02_state_seed",
    "stations season_rolled",
    f"SELECT s.cell_id, {hr('coalesce(ffmc, 85)', 4)} AS ffmc, {hr('coalesce(dmc, 6)', 4)} AS dmc, {hr('coalesce(dc, 15)', 4)} AS dc FROM stations s LEFT JOIN"
    " (SELECT cell_id, arg_max(ffmc, date) AS ffmc, arg_max(dmc, date) AS dmc, arg_max(dc, date) AS dc, max(date) AS last FROM season_rolled WHERE rn > 0 GROUP BY 1) x ON x.cell_id = s.cell_id AND last >= DATE '2001-10-25'",
)
def _(d):
    held = T.final_state(T.fold_codes(d.weather)).where(F.col("as_of") >= F.lit("2001-10-25").cast("date"))
    return rounded(T.seed_state(d.stations, held), {"ffmc": 4, "dmc": 4, "dc": 4})


# Forecast: nodes whose lead days run 1, 2, ... without a gap.
cte(
    "lead_days",
    "node_weather",
    "SELECT * FROM (SELECT wx_id AS cell_id, lead_day, temperature_c AS t, rh_pct AS h, wind_kmh AS w, precip_24h_mm AS r, month(DATE '2001-06-26' + lead_day) AS mon, 0 AS grp, lead_day::BIGINT AS rn,"
    " row_number() OVER (PARTITION BY wx_id ORDER BY lead_day) AS ord FROM node_weather) WHERE ord = lead_day",
)
cte(
    "forecast_rolled",
    "lead_days",
    "(SELECT cell_id, 0::BIGINT AS rn, 0.0::DOUBLE AS t, 0.0::DOUBLE AS h, 0.0::DOUBLE AS w, 0.0::DOUBLE AS r, 85.0::DOUBLE AS ffmc, 6.0::DOUBLE AS dmc, 15.0::DOUBLE AS dc FROM lead_days GROUP BY 1) UNION ALL ("
    + S.one_step(
        "SELECT n.*, p.ffmc AS f0, p.dmc AS p0, p.dc AS d0 FROM forecast_rolled p JOIN lead_days n ON n.cell_id = p.cell_id AND n.rn = p.rn + 1", "cell_id, rn, t, h, w, r"
    )
    + ")",
)
_RISK = f"({S.clip(f'0.5::DOUBLE * {S.clip("(t - 10) / 30.0::DOUBLE", 0, 1)} + 0.5::DOUBLE * {S.clip("fwi / 40.0::DOUBLE", 0, 1)}', 0, 1)} * pow(0.95::DOUBLE, rn))"
cte("forecast_scored", "forecast_rolled", f"SELECT *, {_RISK} AS risk FROM ({S.with_spread('SELECT * FROM forecast_rolled WHERE rn > 0')})")


@query(
    "w03_forecast_roll",
    "forecast_scored",
    f"SELECT cell_id::BIGINT AS wx_id, rn AS lead_day, {hr('ffmc', 4)} AS ffmc, {hr('dmc', 4)} AS dmc, {hr('dc + 3e-9', 6)} AS dc, {hr('fwi', 4)} AS fwi, {hr('risk', 6)} AS risk_score, {S.level('risk')} AS danger_label FROM forecast_scored",
)
def _(d):
    got = T.forecast_roll(d.node_weather, "2001-06-26", key="wx_id").select("wx_id", "lead_day", "ffmc", "dmc", "dc", "fwi", "risk_score", "danger_label")
    # the small shift keeps exact decimal ties from falling either way
    return rounded(got.withColumn("dc", F.col("dc") + 3e-9), {"ffmc": 4, "dmc": 4, "dc": 6, "fwi": 4, "risk_score": 6})


@query("w04_percentiles", "ranked", "SELECT cell_id, susceptibility_percentile, exposure_percentile FROM ranked")
def _(d):
    return d.statistics().select("cell_id", "susceptibility_percentile", "exposure_percentile")


_VEL = lambda p: br(f"(score - {p}) / nullif({p}, 0) * 100.0::DOUBLE", 1)
def _velocities(history: str) -> str:
    return (
        f"SELECT cell_id, n AS days_analyzed, CASE WHEN n >= 4 AND p3 > 0 THEN {_VEL('p3')} END AS v3, CASE WHEN n >= 7 AND p7 > 0 THEN {_VEL('p7')} END AS v7 FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY date) AS rn,"
        f" count(*) OVER (PARTITION BY cell_id) AS n, lag(score, 3) OVER (PARTITION BY cell_id ORDER BY date) AS p3, coalesce(lag(score, 7) OVER (PARTITION BY cell_id ORDER BY date), lag(score, 6) OVER (PARTITION BY cell_id ORDER BY date)) AS p7 FROM {history}) WHERE rn = n"
    )


cte("velocities", "history", _velocities("history"))
TREND_DAYS = 720
cte("recent_velocities", "history", _velocities(f"(SELECT * FROM history WHERE date BETWEEN DATE '{DAY}' - {TREND_DAYS} AND DATE '{DAY}')"))


@query("w05_velocity", "velocities", "SELECT cell_id, days_analyzed, v3 AS velocity_3day_pct, v7 AS velocity_7day_pct FROM velocities")
def _(d):
    return T.velocity(d.history)


@query(
    "w06_top_drivers",
    "contribution_rows",
    f"SELECT cell_id, rank, feature, {br('c', 6)} AS contribution, v AS value, CASE WHEN c > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM"
    " (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(c) DESC, feature) AS rank FROM contribution_rows) WHERE rank <= 5",
)
def _(d):
    drivers = V.top_drivers(F.col("contributions"), F.col("feature_values"), 5)
    rows = d.explained.select("cell_id", F.posexplode(drivers).alias("rank", "x"))
    return rows.select("cell_id", (F.col("rank") + 1).alias("rank"), "x.feature", "x.contribution", "x.value", "x.direction")


def _height(d) -> int:
    return d.raster.agg(F.max("row")).first()[0] + 1


_GRAD = lambda axis, other: (
    f"CASE WHEN {axis} = 0 THEN (lead(value) OVER {other} - value) / 11100.0::DOUBLE WHEN {axis} = max({axis}) OVER () THEN (value - lag(value) OVER {other}) / 11100.0::DOUBLE"
    f" ELSE (lead(value) OVER {other} - lag(value) OVER {other}) / 22200.0::DOUBLE END"
)
_SL = "atan(sqrt(dx * dx + dy * dy))"


@query(
    "w07_terrain",
    "raster",
    f"SELECT row, col, {hr(f'degrees({_SL})', 5)} AS slope_deg, {hr('fmod(degrees(atan2(-dy, dx)) + 360, 360)', 5)} AS aspect_deg,"
    f" {hr(S.clip(f'255 * (cos({_SL}) * {math.cos(math.pi / 4)!r}::DOUBLE + sin({_SL}) * {math.sin(math.pi / 4)!r}::DOUBLE * cos(radians(315) - atan2(-dy, dx)))', 0, 255), 5)} AS hillshade"
    f" FROM (SELECT row, col, {_GRAD('col', '(PARTITION BY row ORDER BY col)')} AS dx, {_GRAD('row', '(PARTITION BY col ORDER BY row)')} AS dy FROM (SELECT row, col, value * 20 AS value FROM raster))",
)
def _(d):
    dem = d.raster.withColumn("value", F.col("value") * 20)
    got = R.terrain(dem, _height(d), 50, 0.1).select("row", "col", "slope_deg", "aspect_deg", "hillshade")
    return rounded(got, {"slope_deg": 5, "aspect_deg": 5, "hillshade": 5})


_BOX = {"south": 48.4, "west": -138.9, "north": 59.9, "east": -114.2}
_HW, _HH, _KERNEL = 128, 96, 4
_RS, _CS = (_BOX["north"] - _BOX["south"]) / _HH, (_BOX["east"] - _BOX["west"]) / _HW


def _mirror(axis: str, size: int) -> str:
    return f"[{axis}, -1 - {axis}, {2 * size - 1} - {axis}]"


cte(
    "heat",
    "scored_cells",
    f"SELECT row, col, arg_max(score, cell_id) AS v FROM (SELECT *, least(greatest(floor(({_BOX['north']}::DOUBLE - lat) / {_RS!r}::DOUBLE), 0), {_HH - 1})::BIGINT AS row,"
    f" least(greatest(floor((lon - {_BOX['west']}::DOUBLE) / {_CS!r}::DOUBLE), 0), {_HW - 1})::BIGINT AS col FROM scored_cells WHERE lat BETWEEN {_BOX['south']}::DOUBLE AND {_BOX['north']}::DOUBLE AND lon BETWEEN {_BOX['west']}::DOUBLE AND {_BOX['east']}::DOUBLE) GROUP BY 1, 2",
)
cte(
    "heat_smooth",
    "heat",
    f"SELECT i + a AS row, j + b AS col, sum(v) AS v, count(*) AS w FROM (SELECT v, unnest({_mirror('row', _HH)}) AS i, col FROM heat) CROSS JOIN (SELECT unnest(range(-1, 3)) AS a)"
    f" CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) CROSS JOIN (SELECT unnest(range(-1, 3)) AS b) CROSS JOIN LATERAL (SELECT {_mirror('col', _HW)}[m + 1] AS j)"
    f" WHERE i + a BETWEEN 0 AND {_HH - 1} AND j + b BETWEEN 0 AND {_HW - 1} GROUP BY 1, 2",
)


@query(
    "w08_heatmap",
    "heat_smooth",
    f"SELECT r AS row, c AS col, {hr('coalesce(v / w, 0) + 3e-11', 7)} AS score FROM (SELECT unnest(range({_HH})) AS r) CROSS JOIN (SELECT unnest(range({_HW})) AS c) LEFT JOIN heat_smooth ON row = r AND col = c",
)
def _(d):
    got = R.heatmap(d.scored_cells, **_BOX, width=_HW, height=_HH).select("row", "col", (F.col("score") + 3e-11).alias("score"))
    return rounded(got, {"score": 7})


_Z = [4, 5, 6, 7]
cte(
    "tile_hits",
    "scored_cells",
    "SELECT *, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) AS s, x / pow(2, z) * 360 - 180 AS west, (x + 1) / pow(2, z) * 360 - 180 AS east,"
    " greatest(1, floor(5.0::DOUBLE * 0.02::DOUBLE * pow(2, z)))::BIGINT // 2 AS half FROM (SELECT cell_id, score, lat, lon, z, floor((lon + 180) / 360 * pow(2, z))::BIGINT + dx AS x,"
    " floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z))::BIGINT AS y FROM scored_cells CROSS JOIN (SELECT unnest([4, 5, 6, 7]) AS z) CROSS JOIN (SELECT unnest([-1, 0]) AS dx))",
)


@query(
    "w09_tiles",
    "tile_hits",
    "SELECT z, x, y, py, px, arg_max(score, cell_id) AS score FROM (SELECT z, x, y, cell_id, score, unnest(range(greatest(r - half, 0), least(r + half, 255) + 1)) AS py, px FROM (SELECT z, x, y, cell_id, score, r, half,"
    " unnest(range(greatest(c - half, 0), least(c + half, 255) + 1)) AS px FROM (SELECT *, least(floor((n - lat) / ((n - s) / 256)), 255)::BIGINT AS r, least(floor((lon - west) / ((east - west) / 256)), 255)::BIGINT AS c FROM tile_hits"
    " WHERE lat BETWEEN s AND n AND lon BETWEEN west AND east))) GROUP BY 1, 2, 3, 4, 5",
)
def _(d):
    return R.tiles(d.scored_cells, _Z).drop("rgba")


@query(
    "w10_keep_first",
    "fires",
    "SELECT lat, lon, year, min(fire_id) AS fire_id, arg_min(size_ha, fire_id) AS size_ha FROM (SELECT round(lat * 2) / 2 AS lat, round(lon * 2) / 2 AS lon, year, fire_id, size_ha FROM fires) GROUP BY 1, 2, 3",
)
def _(d):
    snapped = d.fires.withColumns({"lat": F.round(F.col("lat") * 2, 0) / 2, "lon": F.round(F.col("lon") * 2, 0) / 2})
    return FS.keep_first_fire(snapped).select("lat", "lon", "year", "fire_id", "size_ha")


@query("w11_forecast_maximum", "forecast_scored", f"SELECT cell_id::BIGINT AS wx_id, {hr('nullif(max(CASE WHEN rn <= 3 THEN risk END), 0)', 6)} AS forecast_3day_max FROM forecast_scored GROUP BY 1")
def _(d):
    rolled = T.forecast_roll(d.node_weather, "2001-06-26", key="wx_id").withColumnRenamed("wx_id", "cell_id")
    return rounded(V.forecast_maximum(rolled), {"forecast_3day_max": 6}).withColumnRenamed("cell_id", "wx_id")


@query(
    "w12_alert_step",
    "alerts due",
    "SELECT alert_id, (is_active AND NOT off)::BIGINT AS is_active, fails::BIGINT AS consecutive_failures, coalesce(CASE WHEN fired AND ok THEN TIMESTAMP '" + NOW + "' ELSE last_triggered END::VARCHAR, 'never') AS last_triggered FROM"
    " (SELECT *, fired AND NOT ok AND fails >= 5 AS off FROM (SELECT a.*, d.alert_id IS NOT NULL AS fired, a.alert_id % 3 <> 0 AS ok, CASE WHEN d.alert_id IS NOT NULL AND a.alert_id % 3 <> 0 THEN 0 WHEN d.alert_id IS NOT NULL THEN a.consecutive_failures + 1 ELSE a.consecutive_failures END AS fails"
    " FROM alerts a LEFT JOIN due d ON a.alert_id = d.alert_id))",
)
def _(d):
    outcomes = d.alerts.select("alert_id", (F.col("alert_id") % 3 != 0).alias("delivered"))
    got = A.alert_step(d.alerts, due(d), outcomes)
    return got.select("alert_id", "is_active", "consecutive_failures", F.coalesce(F.col("last_triggered").cast("string"), F.lit("never")).alias("last_triggered"))


@query(
    "w13_walk_forward",
    "labels_t",
    "SELECT t AS test_year, CASE WHEN year = t THEN 'test' ELSE 'train' END AS role, count(*) AS rows, sum(y)::BIGINT AS positives FROM labels_t CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS t) WHERE year = t OR (year >= 1995 AND year < t) GROUP BY 1, 2",
)
def _(d):
    got = N.walk_forward(d.labels, 1995, [1998, 1999, 2000])
    return got.groupBy("test_year", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"))


_H48 = lambda ids: "('0x' || substr(md5(concat_ws('|', '42', " + ", ".join(ids) + ")), 1, 12))::BIGINT"
cte("hashed", "labels_t", f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_H48(['row_a', 'row_b', 'row_c'])}, row_a, row_b, row_c) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM labels_t")


@query("w14_stratified_folds", "hashed", "SELECT row_a, row_b, row_c, y::BIGINT AS y, (r % 5)::BIGINT AS fold FROM hashed")
def _(d):
    return N.folds(d.labels, "y", ["row_a", "row_b", "row_c"], 5).select("row_a", "row_b", "row_c", "y", "fold")


@query(
    "w14_three_way_split",
    "hashed",
    "SELECT row_a, row_b, row_c, CASE WHEN (r + 0.5::DOUBLE) / n < 0.8::DOUBLE THEN 'train' WHEN (r + 0.5::DOUBLE) / n < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM hashed",
)
def _(d):
    return N.three_way_split(d.labels, "y", ["row_a", "row_b", "row_c"]).select("row_a", "row_b", "row_c", "split")


@query(
    "w15_cell_numbers",
    "raster",
    "SELECT row, col, 'BC-5K-' || lpad((row_number() OVER (ORDER BY row, col) - 1)::VARCHAR, 7, '0') AS cell_id FROM raster WHERE (row * 7 + col * 3) % 5 > 0",
)
def _(d):
    kept = d.raster.select("row", "col").where((F.col("row") * 7 + F.col("col") * 3) % 5 > 0)
    return number_cells(kept, 5.0)


# --- sort, limit, top-k -----------------------------------------------------------------------------------------


@query(
    "l01_nearest_three_fires",
    "locations active_fires",
    f"SELECT location_id, fire_id, rank, {br('km', 1)} AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY {br('km', 1)}, fire_id) AS rank FROM (SELECT l.location_id, f.fire_id, {S.haversine('l.lat', 'l.lon', 'f.lat', 'f.lon')} AS km"
    " FROM locations l CROSS JOIN active_fires f) WHERE km <= 150) WHERE rank <= 3",
)
def _(d):
    points = d.locations.withColumn("radius_km", F.lit(150.0))
    return nearest_fires(points, d.active_fires, 3).select("location_id", "fire_id", "rank", "distance_km")


@query("l02_zones_by_count", "cells", "SELECT bec_zone, count(*) AS cells FROM cells GROUP BY 1 ORDER BY 2 DESC, 1")
def _(d):
    return d.cells.groupBy("bec_zone").agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), "bec_zone")


@query("l03_labels_in_order", "labels_t", "SELECT bec_zone, date::VARCHAR AS date, count(*) AS rows, sum(y)::BIGINT AS positives FROM labels_t GROUP BY 1, 2")
def _(d):
    got = d.labels.groupBy("bec_zone", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"))
    return got.repartitionByRange("date").sortWithinPartitions("date", "bec_zone")


@query("l04_latest_image", "weather", f"SELECT cell_id, max(date)::VARCHAR AS date, {hr('arg_max(rh_pct, date)', 6)} AS rh_pct FROM weather GROUP BY 1")
def _(d):
    return rounded(V.latest(d.weather, ["rh_pct"], run="date"), {"rh_pct": 6})


@query(
    "l05_top3_drivers",
    "contribution_rows",
    "SELECT cell_id, string_agg(feature, ',' ORDER BY rank) AS features FROM (SELECT cell_id, feature, row_number() OVER (PARTITION BY cell_id ORDER BY abs(c) DESC, feature) AS rank FROM contribution_rows) WHERE rank <= 3 GROUP BY 1",
)
def _(d):
    drivers = V.top_drivers(F.col("contributions"), F.col("feature_values"), 3)
    return d.explained.select("cell_id", F.array_join(F.transform(drivers, lambda x: x["feature"]), ",").alias("features"))


# Draws of the negative sample, then everything the operator does, by plain SQL.
cte("pool", "weather", "SELECT list_sort(list(DISTINCT date)) AS p FROM weather")
cte("wanted", "fire_days", "SELECT count(*) * 10 AS n FROM fire_days")
cte(
    "draws",
    "stations wanted pool",
    "SELECT DISTINCT cell_id, p[('0x' || substr(md5(concat_ws('|', '42', cell_id, draw)), 1, 12))::BIGINT % len(p) + 1] AS date FROM (SELECT cell_id, unnest(range(1, (greatest(ceil((SELECT n FROM wanted) * 5 / (SELECT count(*) FROM stations)), 1) + 1)::BIGINT)) AS draw FROM stations) CROSS JOIN pool",
)
cte(
    "negatives",
    "draws excluded wanted",
    f"SELECT cell_id, date FROM (SELECT *, row_number() OVER (ORDER BY {_H48(['cell_id', 'date::VARCHAR'])}, cell_id, date) AS rn FROM draws ANTI JOIN excluded USING (cell_id, date)) WHERE rn <= (SELECT n FROM wanted)",
)


@query("l06_negative_samples", "negatives", "SELECT cell_id, date::VARCHAR AS date FROM negatives")
def _(d):
    return N.negative_samples(P.assign_fires(d.fires, d.stations), d.stations, d.weather.select("date"))


@query(
    "l07_all_locations_answered",
    "locations",
    "SELECT count(*) AS asked, count(DISTINCT location_id) AS answered FROM locations",
)
def _(d):
    found = V.locate(d.locations, d.cells, "location_id")
    return found.agg(F.count(F.lit(1)).alias("asked"), F.count_distinct("location_id").alias("answered"))


@query(
    "l08_importance_sample",
    "labels_t",
    f"SELECT row_a, row_b, row_c FROM labels_t ORDER BY {_H48(['row_a', 'row_b', 'row_c'])}, row_a, row_b, row_c LIMIT 5000",
)
def _(d):
    return N.hash_sample(d.labels.select("row_a", "row_b", "row_c"), 5000, ["row_a", "row_b", "row_c"])


# --- sets -----------------------------------------------------------------------------------------------------------


@query("e01_union_sources", "fires", "SELECT source, count(*) AS records, sum(cause IS NULL)::BIGINT AS without_cause FROM (SELECT source, CASE WHEN source = 'cnfdb' THEN NULL ELSE cause END AS cause FROM fires) GROUP BY 1")
def _(d):
    parts = [d.fires.where(F.col("source") == s) for s in ("bc_incidents", "bc_perimeters")]
    whole = fire_history([d.fires.where(F.col("source") == "cnfdb").drop("cause"), *parts])
    return whole.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("cause").isNull()).alias("without_cause"))


@query("e02_distinct_dates", "weather", "SELECT DISTINCT date::VARCHAR AS date FROM weather")
def _(d):
    return d.weather.select("date").distinct()


@query("e03_cells_without_state", "cells history", f"SELECT cell_id FROM cells EXCEPT SELECT cell_id FROM history WHERE date >= DATE '{DAY}'")
def _(d):
    held = d.history.where(F.col("date") >= F.lit(DAY).cast("date")).select("cell_id")
    return d.cells.select("cell_id").join(held, "cell_id", "left_anti")


@query("e04_common_zones", "cells labels_t", "SELECT bec_zone FROM cells INTERSECT SELECT bec_zone FROM labels_t")
def _(d):
    return d.cells.select("bec_zone").intersect(d.labels.select("bec_zone"))


