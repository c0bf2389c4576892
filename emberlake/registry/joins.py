"""Registered joins: J01-J23."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake import constants as K
from emberlake.functions import geo as G
from emberlake.ml.fuse import parameter_frame, with_parameters
from emberlake.operators import alerts as A
from emberlake.operators import raster as R
from emberlake.operators import sampling
from emberlake.operators import spatial as P
from emberlake.operators import temporal as T
from emberlake.operators.firestats import matched_fires
from emberlake.operators.metrics import observed_labels
from emberlake.operators.serving import locate, star_lookup
from emberlake.plans.answers import fires_near
from emberlake.plans.grid import candidate_centres
from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import DEM, NOW, cte

hr, br = S.hr, S.br


def _nearest_sql(points: str, pid: str, cells: str = "cells") -> str:
    return (
        f"SELECT p.{pid}, min({{'d2': pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2), 'id': c.cell_id}}) AS m FROM {points} p CROSS JOIN {cells} c GROUP BY 1"
    )


cte("fire_cell", "fires cells", f"SELECT fire_id, m.id AS cell_id, m.d2 AS d2 FROM ({_nearest_sql('fires', 'fire_id')})")
cte("fire_station", "fires stations", f"SELECT fire_id, m.id AS cell_id, m.d2 AS d2 FROM ({_nearest_sql('fires', 'fire_id', 'stations')})")
cte(
    "location_cell",
    "locations cells",
    "SELECT location_id, m.id AS cell_id FROM ("
    + _nearest_sql(
        f"(SELECT * FROM locations WHERE lat BETWEEN {K.LAT_MIN}::DOUBLE AND {K.LAT_MAX}::DOUBLE AND lon BETWEEN {K.LON_MIN}::DOUBLE AND {K.LON_MAX}::DOUBLE)",
        "location_id",
    )
    + ")",
)
cte(
    "property_cell",
    "properties cells",
    "SELECT property_id, m.id AS cell_id FROM ("
    + _nearest_sql(
        f"(SELECT * FROM properties WHERE lat BETWEEN {K.LAT_MIN}::DOUBLE AND {K.LAT_MAX}::DOUBLE AND lon BETWEEN {K.LON_MIN}::DOUBLE AND {K.LON_MAX}::DOUBLE)",
        "property_id",
    )
    + ")",
)
cte(
    "fire_pairs",
    "cells fires",
    f"SELECT cell_id, bec_zone, fire_id, year, cause, size_ha, flat, flon, km FROM (SELECT c.cell_id, c.bec_zone, f.fire_id, f.year, f.cause, f.size_ha, f.lat AS flat, f.lon AS flon,"
    f" {S.haversine('c.lat', 'c.lon', 'f.lat', 'f.lon')} AS km FROM cells c JOIN fires f ON f.lat BETWEEN c.lat - 0.2::DOUBLE AND c.lat + 0.2::DOUBLE) WHERE km <= 10",
)
cte(
    "envelope",
    "cells",
    "SELECT bec_zone, min(lat) - 0.1::DOUBLE AS lat_min, max(lat) + 0.1::DOUBLE AS lat_max, min(lon) - 0.1::DOUBLE AS lon_min, max(lon) + 0.1::DOUBLE AS lon_max FROM cells GROUP BY 1",
)
cte("fire_days", "fire_station", f"SELECT DISTINCT cell_id, o_orderdate::DATE AS date FROM fire_station JOIN orders ON fire_id = o_orderkey WHERE sqrt(d2) < {K.FIRE_CELL_CAP_DEG}::DOUBLE")
cte("around", "stations fire_days", f"SELECT a.cell_id AS fire_cell, b.cell_id FROM (SELECT DISTINCT cell_id FROM fire_days) f JOIN stations a USING (cell_id) CROSS JOIN stations b WHERE pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) <= {K.FIRE_RADIUS_KM / K.KM_PER_DEG!r}::DOUBLE * {K.FIRE_RADIUS_KM / K.KM_PER_DEG!r}::DOUBLE")
cte("excluded", "around fire_days", "SELECT DISTINCT a.cell_id, (f.date + o)::DATE AS date FROM fire_days f JOIN around a ON a.fire_cell = f.cell_id CROSS JOIN (SELECT unnest(range(-7, 8))::INT AS o)")


@query("j01_nearest_cell", "fire_cell", f"SELECT fire_id, cell_id, {hr('sqrt(d2)', 6)} AS distance FROM fire_cell")
def _(d):
    return rounded(P.nearest(d.fires.select("fire_id", "lat", "lon"), d.cells, "fire_id", "cell_id").drop("lat", "lon"), {"distance": 6})


@query("j02_fires_to_cells", "fire_days", "SELECT cell_id, date::VARCHAR AS date FROM fire_days")
def _(d):
    return P.assign_fires(d.fires, d.stations)


_NODE = (
    f"least(greatest(round((lat - {K.LAT_MIN}::DOUBLE) / {K.WEATHER_STEP_DEG}::DOUBLE), 0), {K.WEATHER_ROWS - 1}) * {K.WEATHER_COLS}"
    f" + least(greatest(round((lon - {K.LON_MIN}::DOUBLE) / {K.WEATHER_STEP_DEG}::DOUBLE), 0), {K.WEATHER_COLS - 1})"
)


@query(
    "j03_weather_grid_to_cells",
    "cells node_weather",
    f"SELECT cell_id, lead_day::BIGINT AS lead_day, {hr('temperature_c', 6)} AS temperature_c, {hr('rh_pct', 6)} AS rh_pct, {hr('wind_kmh', 6)} AS wind_kmh"
    f" FROM (SELECT cell_id, ({_NODE})::BIGINT AS wx_id FROM cells) JOIN node_weather USING (wx_id)",
)
def _(d):
    mapped = d.cells.select("cell_id", G.weather_node(F.col("lat"), F.col("lon")).alias("wx_id"))
    got = mapped.join(d.node_weather, "wx_id").select("cell_id", "lead_day", "temperature_c", "rh_pct", "wind_kmh")
    return rounded(got, {"temperature_c": 6, "rh_pct": 6, "wind_kmh": 6})


@query(
    "j04_road_distance",
    "cells active_fires",
    f"SELECT cell_id, {hr(f'least(sqrt(min(pow((c.lat - v.lat) * 111, 2) + pow((c.lon - v.lon) * {G.KM_PER_DEG_LON!r}::DOUBLE, 2))), 60)', 5)} AS distance_to_road_km FROM cells c CROSS JOIN active_fires v GROUP BY 1",
)
def _(d):
    vertices = d.active_fires.select(F.col("fire_id").alias("vertex_id"), "lat", "lon")
    got = P.road_distance(d.cells.select("cell_id", "lat", "lon"), vertices, cap_km=60.0)
    return rounded(got.select("cell_id", "distance_to_road_km"), {"distance_to_road_km": 5})


@query("j05_fires_within_10km", "fire_pairs", f"SELECT cell_id, fire_id, {hr('km', 6)} AS distance_km FROM fire_pairs")
def _(d):
    got = P.within_radius(d.cells.select("cell_id", "lat", "lon"), d.fires.select("fire_id", "lat", "lon"))
    return rounded(got.select("cell_id", "fire_id", "distance_km"), {"distance_km": 6})


@query(
    "j06_fires_near_points",
    "locations active_fires",
    f"SELECT location_id, fire_id, {br('km', 1)} AS distance_km FROM (SELECT l.location_id, f.fire_id, 1 + location_id % 120 AS radius_km, {S.haversine('l.lat', 'l.lon', 'f.lat', 'f.lon')} AS km"
    " FROM locations l CROSS JOIN active_fires f) WHERE km <= radius_km",
)
def _(d):
    points = d.locations.withColumn("radius_km", (F.col("location_id") % 120 + 1).cast("double"))
    return fires_near(points, d.active_fires).select("location_id", "fire_id", "distance_km")


@query(
    "j07_zone_envelope",
    "cells fires envelope",
    "SELECT bec_zone, fire_id FROM fires JOIN envelope ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max",
)
def _(d):
    return P.in_zone_envelope(d.fires, P.zone_envelope(d.cells)).select("bec_zone", "fire_id")


@query(
    "j07_parity_pairs",
    "fire_pairs envelope",
    "SELECT cell_id, count(*) AS fires FROM fire_pairs JOIN envelope USING (bec_zone) WHERE flat BETWEEN lat_min AND lat_max AND flon BETWEEN lon_min AND lon_max GROUP BY 1",
)
def _(d):
    totals = matched_fires(d.cells, d.fires, parity_envelope=True, since={"all": None})
    return totals.groupBy("cell_id").agg(F.sum("n_all").alias("fires"))


@query("j08_exclusion_zone", "excluded", "SELECT cell_id, date::VARCHAR AS date FROM excluded")
def _(d):
    return P.exclusion_zone(P.assign_fires(d.fires, d.stations), d.stations)


@query("j09_fire_free_days", "weather excluded", "SELECT cell_id, date::VARCHAR AS date FROM weather ANTI JOIN excluded USING (cell_id, date)")
def _(d):
    masks = P.excluded_days(P.assign_fires(d.fires, d.stations), d.stations)
    return P.outside_zone(d.weather.select("cell_id", "date"), masks)


@query(
    "j10_labels_features",
    "fire_days weather",
    f"SELECT cell_id, date::VARCHAR AS date, 1::BIGINT AS fire, {hr('temperature_c', 6)} AS temperature_c FROM fire_days JOIN weather USING (cell_id, date)",
)
def _(d):
    labels = P.assign_fires(d.fires, d.stations).select("cell_id", "date", F.lit(1).alias("fire"))
    got = sampling.training_rows(labels, d.weather.select("cell_id", "date", "temperature_c"))
    return rounded(got, {"temperature_c": 6})


_PIX = f"floor(({DEM['north']}::DOUBLE - lat) / {DEM['step']}::DOUBLE)::BIGINT AS row, floor((lon - {DEM['west']}::DOUBLE) / {DEM['step']}::DOUBLE)::BIGINT AS col"


@query("j11_raster_sample", "cells raster", f"SELECT cell_id, value FROM (SELECT cell_id, {_PIX} FROM cells) LEFT JOIN raster USING (row, col)")
def _(d):
    return R.sample(d.cells.select("cell_id", "lat", "lon"), d.raster, **DEM).select("cell_id", "value")


@query(
    "j11_annual_vegetation",
    "cells raster",
    f"SELECT cell_id, {hr('coalesce(value * 3 * 0.0001::DOUBLE, 0.5)', 6)} AS ndvi, coalesce((value / 20 > 50)::INT, 0)::DOUBLE AS snow_cover, {hr('coalesce(value / 10 * 0.1::DOUBLE, 2)', 6)} AS lai"
    f" FROM (SELECT cell_id, {_PIX} FROM cells) LEFT JOIN raster USING (row, col)",
)
def _(d):
    bands = d.raster.select("row", "col", (F.col("value") * 3).alias("ndvi"), (F.col("value") / 20).alias("snow"), (F.col("value") / 10).alias("lai"))
    got = R.annual_vegetation(d.cells.select("cell_id", "lat", "lon"), bands, **DEM).drop("lat", "lon")
    return rounded(got, {"ndvi": 6, "lai": 6})


@query("j12_semi_join", "weather fire_days", "SELECT cell_id, date::VARCHAR AS date FROM weather SEMI JOIN (SELECT DISTINCT cell_id, date FROM fire_days) USING (cell_id, date)")
def _(d):
    wanted = P.assign_fires(d.fires, d.stations)
    return d.weather.select("cell_id", "date").join(wanted, ["cell_id", "date"], "left_semi")


_DUE = (
    "alerts a JOIN predictions p USING (cell_id) WHERE is_active AND a.api_key % 10 <> 7 AND score >= threshold"
    f" AND (last_triggered IS NULL OR TIMESTAMP '{NOW}' - last_triggered >= INTERVAL 24 HOUR)"
)
cte("due", "alerts predictions", f"SELECT a.*, score FROM {_DUE}")


def active_keys(d):
    return d.alerts.select("api_key").distinct().where(F.col("api_key") % 10 != 7)


def due(d):
    return A.due_alerts(d.alerts, active_keys(d), d.predictions, F.lit(NOW).cast("timestamp"))


@query("j13_due_alerts", "due", f"SELECT alert_id, api_key::BIGINT AS api_key, cell_id, score, {S.level('score')} AS level FROM due")
def _(d):
    return due(d).select("alert_id", "api_key", "cell_id", "score", "level")


_ERR = (
    f"CASE WHEN lat NOT BETWEEN {K.LAT_MIN}::DOUBLE AND {K.LAT_MAX}::DOUBLE THEN 'latitude outside coverage'"
    f" WHEN lon NOT BETWEEN {K.LON_MIN}::DOUBLE AND {K.LON_MAX}::DOUBLE THEN 'longitude outside coverage'"
    " WHEN score IS NULL THEN 'No prediction data available' ELSE 'ok' END"
)


@query(
    "j14_star_lookup",
    "locations location_cell cells history",
    f"SELECT location_id, cell_id, {_ERR} AS error, bec_zone, score FROM (SELECT l.*, m.cell_id, c.bec_zone, p.score FROM locations l LEFT JOIN location_cell m USING (location_id)"
    " LEFT JOIN cells c USING (cell_id) LEFT JOIN (SELECT cell_id, arg_max(score, date) AS score FROM history WHERE score > 0.3::DOUBLE GROUP BY 1) p USING (cell_id))",
)
def _(d):
    from emberlake.operators.serving import latest

    known = latest(d.history.where(F.col("score") > 0.3), ["score"], run="date").select("cell_id", "score")
    rows = star_lookup(locate(d.locations, d.cells, "location_id"), d.cells, known)
    return rows.select("location_id", "cell_id", F.coalesce("error", F.lit("ok")).alias("error"), "bec_zone", "score")


@query(
    "j15_as_of_weather",
    "weather",
    f"SELECT w.cell_id, w.date::VARCHAR AS date, coalesce(max(h.date)::VARCHAR, 'none') AS as_of, {hr('coalesce(arg_max(h.temperature_c, h.date), 0)', 6)} AS temperature_c"
    " FROM weather w LEFT JOIN (SELECT * FROM weather WHERE wind_kmh > 20) h ON h.cell_id = w.cell_id AND h.date BETWEEN w.date - 7 AND w.date GROUP BY 1, 2",
)
def _(d):
    history = d.weather.where(F.col("wind_kmh") > 20)
    got = T.as_of(d.weather.select("cell_id", "date"), history, ["temperature_c"], 7, defaults={"temperature_c": 0.0})
    return rounded(got.withColumn("as_of", F.coalesce(F.col("as_of").cast("string"), F.lit("none"))), {"temperature_c": 6})


@query(
    "j16_latest_composite",
    "weather",
    f"SELECT w.cell_id, w.date::VARCHAR AS date, {hr('coalesce(arg_max(h.rh_pct, h.date) / 100, 0.5)', 6)} AS ndvi"
    " FROM weather w LEFT JOIN (SELECT * FROM weather WHERE day(date) IN (1, 17)) h ON h.cell_id = w.cell_id AND h.date >= w.date - 32 AND h.date < w.date GROUP BY 1, 2",
)
def _(d):
    scenes = d.weather.where(F.dayofmonth("date").isin(1, 17)).select("cell_id", "date", (F.col("rh_pct") / 100).alias("ndvi"))
    got = T.as_of(d.weather.select("cell_id", "date"), scenes, ["ndvi"], 32, include_same_day=False, defaults={"ndvi": 0.5})
    return rounded(got.drop("as_of"), {"ndvi": 6})


@query(
    "j17_soil_merge",
    "weather",
    "SELECT cell_id, date::VARCHAR AS date, CASE WHEN day(date) % 2 = 0 THEN 'primary' WHEN hit THEN 'reanalysis' ELSE 'default' END AS soil_source,"
    f" {hr('CASE WHEN day(date) % 2 = 0 THEN soil_moisture_1 WHEN hit THEN before ELSE 0.25 END', 6)} AS soil_moisture_1"
    " FROM (SELECT *, coalesce(lag(date) OVER days = (date - 1)::DATE, false) AS hit, lag(soil_moisture_1) OVER days AS before FROM weather WINDOW days AS (PARTITION BY cell_id ORDER BY date))",
)
def _(d):
    feed = d.weather.select("cell_id", "date", F.when(F.dayofmonth("date") % 2 == 0, F.col("soil_moisture_1")).alias("soil_moisture_1"))
    lagged = d.weather.select("cell_id", F.date_add("date", 1).alias("date"), "soil_moisture_1")
    got = T.merge_missing(feed, lagged, ["soil_moisture_1"], ["cell_id", "date"], "reanalysis")
    return rounded(got.fillna({"soil_moisture_1": 0.25}), {"soil_moisture_1": 6})


_RING = G.boundary_xy()
_CROSS = " + ".join(
    f"(CASE WHEN (({y1!r}::DOUBLE > y) <> ({y2!r}::DOUBLE > y)) AND x < ((y - {y1!r}::DOUBLE) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1!r}::DOUBLE) THEN 1 ELSE 0 END)"
    for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1])
    if y1 != y2
)


def projected_sql(source: str) -> str:
    from emberlake.registry.columns import _RHO, _THETA

    return f"SELECT *, 1000000 + {_RHO} * sin({_THETA}) AS x, {G._RHO0!r}::DOUBLE - {_RHO} * cos({_THETA}) AS y FROM ({source})"


@query("j18_inside_boundary", "locations", f"SELECT location_id, (({_CROSS}) % 2)::BIGINT AS inside FROM ({projected_sql('SELECT * FROM locations')})")
def _(d):
    x, y = G.albers_forward(F.col("lat"), F.col("lon"))
    got = d.locations.select("location_id", x.alias("x"), y.alias("y"))
    return got.select("location_id", G.inside_polygon(F.col("x"), F.col("y"), _RING).alias("inside"))


_W5 = S.case_map({z: v[0] for z, v in K.CALIBRATION_5KM.items() if z != "SWB"}, "bec_zone", "1.0::DOUBLE")
_B5 = S.case_map({z: v[1] for z, v in K.CALIBRATION_5KM.items() if z != "SWB"}, "bec_zone", "0.0::DOUBLE")


@query(
    "j19_zone_parameters",
    "labels_t",
    f"SELECT bec_zone, {_W5} AS xgb_weight, {_B5} AS bias, count(*) AS rows FROM labels_t GROUP BY 1",
)
def _(d):
    table = {z: v for z, v in K.CALIBRATION_5KM.items() if z != "SWB"}
    got = with_parameters(d.labels.select("bec_zone"), parameter_frame(d.spark, table), (1.0, 0.0, 0.0))
    return got.groupBy("bec_zone", "xgb_weight", "bias").agg(F.count("*").alias("rows"))


@query(
    "j20_change_24h",
    "history",
    f"SELECT a.cell_id, a.date::VARCHAR AS date, {br('a.score - b.score', 4)} AS change_24h FROM history a LEFT JOIN history b ON a.cell_id = b.cell_id AND b.date = a.date - 1",
)
def _(d):
    return T.change_24h(d.history).select("cell_id", "date", "change_24h")


@query(
    "j21_observed_labels",
    "weather fire_station",
    "SELECT w.cell_id, w.date::VARCHAR AS date, (f.cell_id IS NOT NULL)::BIGINT AS y FROM weather w LEFT JOIN (SELECT DISTINCT cell_id, o_orderdate::DATE AS date FROM fire_station JOIN orders ON fire_id = o_orderkey) f"
    " ON f.cell_id = w.cell_id AND f.date = w.date",
)
def _(d):
    fire_days = P.assign_fires(d.fires, d.stations, cap_deg=float("inf"))
    return observed_labels(d.weather.select("cell_id", "date"), fire_days)


@query(
    "j22_lattice_of_points",
    "cells",
    f"SELECT row::BIGINT AS row, col::BIGINT AS col, count(*) AS points FROM (SELECT floor((y - {min(p[1] for p in _RING)!r}::DOUBLE) / 50000) AS row, floor((x - {min(p[0] for p in _RING)!r}::DOUBLE) / 50000) AS col"
    f" FROM ({projected_sql('SELECT * FROM cells')})) GROUP BY 1, 2",
)
def _(d):
    # the candidate lattice by index arithmetic, with the points that fall on each cell
    frame = candidate_centres(d.spark, 50.0).select("row", "col")
    x, y = G.albers_forward(F.col("lat"), F.col("lon"))
    x0, y0 = min(p[0] for p in _RING), min(p[1] for p in _RING)
    hits = d.cells.groupBy(F.floor((y - y0) / 50000.0).cast("bigint").alias("row"), F.floor((x - x0) / 50000.0).cast("bigint").alias("col")).agg(
        F.count(F.lit(1)).alias("points")
    )
    return frame.join(hits, ["row", "col"])


cte("fresh", "requests alerts", "SELECT api_key, cell_id, threshold, webhook_url, min(request_id) AS request_id FROM requests ANTI JOIN (SELECT * FROM alerts WHERE is_active) USING (api_key, cell_id, threshold, webhook_url) GROUP BY ALL")


@query(
    "j23_accept_requests",
    "fresh alerts",
    "SELECT request_id, api_key::BIGINT AS api_key, cell_id, threshold, webhook_url FROM (SELECT f.*, row_number() OVER (PARTITION BY api_key ORDER BY request_id) + coalesce(held, 0) AS n"
    " FROM fresh f LEFT JOIN (SELECT api_key, count(*) AS held FROM alerts WHERE is_active GROUP BY 1) USING (api_key)) WHERE n <= 10",
)
def _(d):
    return A.accept_requests(d.requests, d.alerts)


