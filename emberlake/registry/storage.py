"""Registered scans and sinks: S01-S21. Each writes the given data in the form the source has and reads it back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from emberlake import constants as K
from emberlake.ml.fuse import parameter_frame
from emberlake.operators import raster as R
from emberlake.operators import serving as V
from emberlake.operators.quality import latest_runs
from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import DAY, DEM, cte
from emberlake.schemas import FEATURE_ROW, TRAINING_ROW
from emberlake.session import fresh_path
from emberlake.sources import readers as IN
from emberlake.sources import writers as OUT

hr = S.hr
_FIRE = "lat, lon, date::VARCHAR AS date, size_ha"


def _written(d, df, name: str, form: str = "parquet", **options) -> str:
    path = fresh_path(d.spark, name)
    df.write.options(**options).format(form).save(path)
    return path


@query("s01_grid_scan", "cells", "SELECT cell_id, lat, lon, bec_zone, fuel_type, elevation_m FROM cells")
def _(d):
    path = _written(d, d.cells.drop("k"), "grid")
    return IN.read_grid(d.spark, path).select("cell_id", "lat", "lon", "bec_zone", "fuel_type", "elevation_m")


@query("s02_fallback_chain", "cells", "SELECT cell_id, lat, lon FROM cells")
def _(d):
    absent = fresh_path(d.spark, "absent")
    return IN.first_available([lambda: IN.read_grid(d.spark, absent), lambda: d.cells]).select("cell_id", "lat", "lon")


def _collections(d, fires, geometry, properties):
    """Feature collections, one per line, from fire rows."""
    feature = F.struct(F.struct(*geometry).alias("geometry"), F.struct(*properties).alias("properties"))
    # one collection per row keeps the lines short
    return _written(d, fires.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")), "features", "text")


def _cnfdb(d):
    code = F.when(F.col("cause") == "human", "H-PB").when(F.col("cause") == "lightning", "N").otherwise("RE")
    point = [F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")]
    props = [F.date_format("date", "yyyy/MM/dd").alias("REP_DATE"), F.col("size_ha").alias("SIZE_HA"), code.alias("CAUSE")]
    path = _collections(d, d.fires.where("source = 'cnfdb'"), point, props)
    return IN.cnfdb_features(IN.read_features(d.spark, path, per_line=True))


def _incidents(d):
    words = F.when(F.col("cause") == "human", "Human caused").when(F.col("cause") == "lightning", "LIGHTNING strike").otherwise("Undetermined")
    point = [F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")]
    odd = F.col("fire_id") % 2 == 1
    props = [
        F.when(odd, F.date_format("date", "yyyy-MM-dd")).alias("IGNITION_DATE"),
        F.when(~odd, F.date_format("date", "yyyyMMdd")).alias("START_DATE"),
        F.when(odd, F.col("size_ha")).alias("CURRENT_SIZE"),
        F.when(~odd, F.col("size_ha")).alias("FIRE_SIZE"),
        words.alias("FIRE_CAUSE"),
    ]
    path = _collections(d, d.fires.where("source = 'bc_incidents'"), point, props)
    return IN.incident_features(IN.read_features(d.spark, path, per_line=True))


def _perimeters(d):
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(F.array(lon - 0.25, lat - 0.125), F.array(lon + 0.25, lat - 0.125), F.array(lon + 0.25, lat + 0.125), F.array(lon - 0.25, lat + 0.125), F.array(lon - 0.25, lat - 0.125))
    shape = [F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")]
    props = [F.col("year").cast("string").alias("FIRE_YEAR"), F.col("size_ha").alias("FIRE_SIZE_HECTARES"), F.upper("cause").alias("FIRE_CAUSE")]
    path = _collections(d, d.fires.where("source = 'bc_perimeters'"), shape, props)
    return IN.perimeter_features(IN.read_features(d.spark, path, per_line=True))


@query(
    "s03_fire_history",
    "fires",
    "SELECT source, cause, count(*) AS records, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date, "
    + hr("sum(size_ha)", 2)
    + " AS size_ha FROM (SELECT source, cause, size_ha, CASE WHEN source = 'bc_perimeters' THEN make_date(year, 1, 1) ELSE date END AS date FROM fires) GROUP BY 1, 2",
)
def _(d):
    whole = IN.fire_history([_cnfdb(d), _incidents(d), _perimeters(d)])
    got = whole.groupBy("source", "cause").agg(F.count(F.lit(1)).alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("size_ha").alias("size_ha"))
    return rounded(got, {"size_ha": 2})


@query(
    "s04_fire_csv",
    "fires",
    "SELECT lat, lon, date::VARCHAR AS date, CASE WHEN fire_id % 5 = 0 THEN 0 ELSE size_ha END::DOUBLE AS size_ha FROM fires",
)
def _(d):
    raw = d.fires.select(
        F.col("lat").alias("Latitude"), F.col("lon").alias("LONGITUDE"), F.date_format("date", "yyyy-MM-dd").alias("rep_date"), F.when(F.col("fire_id") % 5 != 0, F.col("size_ha")).alias("Size_Ha")
    )
    return IN.read_fire_csv(d.spark, _written(d, raw, "fires-csv", "csv", header=True)).select("lat", "lon", "date", "size_ha")


@query("s05_coded_features", "fires", f"SELECT {_FIRE}, cause FROM fires WHERE source = 'cnfdb'")
def _(d):
    return _cnfdb(d).drop("source")


@query("s06_incidents", "fires", f"SELECT {_FIRE}, cause FROM fires WHERE source = 'bc_incidents'")
def _(d):
    return _incidents(d).drop("source")


@query(
    "s07_perimeters",
    "fires",
    f"SELECT {hr('lat', 6)} AS lat, {hr('lon', 6)} AS lon, make_date(year, 1, 1)::VARCHAR AS date, size_ha, cause FROM fires WHERE source = 'bc_perimeters'",
)
def _(d):
    return rounded(_perimeters(d).drop("source"), {"lat": 6, "lon": 6})


@query("s08_date_pool", "weather", "SELECT DISTINCT date::VARCHAR AS date FROM weather")
def _(d):
    return IN.date_pool(d.spark, _written(d, d.weather.select("cell_id", "date", "rh_pct"), "features"))


@query(
    "s09_model_input",
    "",
    "SELECT event_id, 1::BIGINT AS fire, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1000000 WHEN 2 THEN -1000000 ELSE value END::DOUBLE AS ndvi FROM events",
)
def _(d):
    e = F.col("event_id") % 4
    v = F.when(e == 0, float("nan")).when(e == 1, float("inf")).when(e == 2, float("-inf")).otherwise(F.col("value"))
    return IN.model_input(d.table("events").select("event_id", F.lit(1).alias("fire"), v.alias("ndvi")))


@query(
    "s10_month_files",
    "weather",
    "SELECT year(date) AS year, month(date) AS month, count(*) AS rows, "
    + hr("sum(CASE WHEN year(date) < 1998 THEN rh_pct ELSE rh_pct + 1 END)", 4)
    + " AS rh_sum FROM weather GROUP BY 1, 2",
)
def _(d):
    path = fresh_path(d.spark, "months")
    rows = d.weather.select("cell_id", "date", "rh_pct")
    OUT.write_missing_months(rows.where(F.year("date") < 1998), path)
    # the second run offers all months and must leave the written ones alone
    OUT.write_missing_months(rows.withColumn("rh_pct", F.col("rh_pct") + 1), path)
    got = d.spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"), F.sum("rh_pct").alias("rh_sum"))
    return rounded(got, {"rh_sum": 4})


@query("s11_typed_sink", "weather", "SELECT count(*) AS rows, 32::BIGINT AS columns FROM weather WHERE rh_pct < 0")
def _(d):
    path = fresh_path(d.spark, "typed")
    OUT.write_typed(d.weather.where("rh_pct < 0"), path, FEATURE_ROW)
    back = d.spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(back.columns)))


@query("s11_training_sink", "fire_days", "SELECT cell_id, date::VARCHAR AS date, 1::BIGINT AS fire FROM fire_days")
def _(d):
    from emberlake.operators.spatial import assign_fires

    path = fresh_path(d.spark, "training")
    OUT.write_typed(assign_fires(d.fires, d.stations).withColumn("fire", F.lit(1)), path, TRAINING_ROW)
    return d.spark.read.parquet(path).select("cell_id", "date", "fire")


@query(
    "s12_predictions_sink",
    "history",
    f"SELECT date::VARCHAR AS prediction_date, count(*) AS rows, {hr('sum(CASE WHEN date >= DATE ' + repr('2001-01-01') + ' THEN score * 2 ELSE score END) + 3e-9', 6)} AS total FROM history GROUP BY 1",
)
def _(d):
    path = fresh_path(d.spark, "predictions")
    rows = d.history.select("cell_id", F.col("date").alias("prediction_date"), "score").withColumn("month", F.date_format("prediction_date", "yyyy-MM"))
    OUT.overwrite_partitions(rows, path, ["month"])
    # a rerun of the last months replaces them and nothing else
    OUT.overwrite_partitions(rows.where("month >= '2001-01'").withColumn("score", F.col("score") * 2), path, ["month"])
    got = d.spark.read.parquet(path).groupBy("prediction_date").agg(F.count(F.lit(1)).alias("rows"), (F.sum("score") + 3e-9).alias("total"))
    return rounded(got, {"total": 6})


@query("s13_forecast_sink", "node_weather", f"SELECT lead_day::BIGINT AS lead_day, count(*) AS rows, {hr('sum(temperature_c)', 4)} AS total FROM node_weather GROUP BY 1")
def _(d):
    path = fresh_path(d.spark, "forecast")
    rows = d.node_weather.select("wx_id", "lead_day", "temperature_c").withColumn("base_date", F.lit(DAY).cast("date"))
    for _ in range(2):
        OUT.overwrite_partitions(rows, path, ["base_date"])
    got = d.spark.read.parquet(path).groupBy("lead_day").agg(F.count(F.lit(1)).alias("rows"), F.sum("temperature_c").alias("total"))
    return rounded(got, {"total": 4})


@query("s14_latest_snapshot", "history", f"SELECT cell_id, max(date)::VARCHAR AS date, arg_max(score, date) AS score FROM history WHERE date > DATE '{DAY}' - 365 GROUP BY 1")
def _(d):
    path = fresh_path(d.spark, "latest")
    OUT.replace(V.latest(d.history, ["score"], run="date", since=F.date_sub(F.lit(DAY).cast("date"), 365)), path)
    return d.spark.read.parquet(path)


@query("s15_stats_sink", "ranked", "SELECT cell_id, n10, susceptibility_percentile FROM ranked")
def _(d):
    path = fresh_path(d.spark, "stats")
    OUT.replace(d.cells.select("cell_id"), path)
    OUT.replace(d.statistics(), path)
    return d.spark.read.parquet(path).select("cell_id", F.col("fires_10yr.count").alias("n10"), "susceptibility_percentile")


cte(
    "runs",
    "",
    "SELECT 'run-' || lpad(o_orderkey::VARCHAR, 9, '0') AS run_id, 'job-' || (o_custkey % 50) AS job, o_orderstatus AS status, o_orderdate AS started_at, repeat('x', (o_orderkey % 1500)::INT) AS error FROM orders",
)


@query(
    "s16_run_log",
    "runs",
    "SELECT job, arg_max(run_id, {'t': started_at, 'r': run_id}) AS run_id, arg_max(status, {'t': started_at, 'r': run_id}) AS status, least(arg_max(length(error), {'t': started_at, 'r': run_id}), 1000)::BIGINT AS error_length FROM runs GROUP BY 1",
)
def _(d):
    runs = latest_runs(d.spark.read.parquet(_written(d, d.runs, "runs")))
    return runs.select("job", "run_id", "status", F.length("error").cast("bigint").alias("error_length"))


@query(
    "s16_appended_run",
    "runs",
    "SELECT status, count(*) AS runs, max(least(length(error), 1000))::BIGINT AS longest_error FROM (SELECT status, error FROM runs UNION ALL SELECT 'partial', repeat('y', max(length(error))) FROM runs) GROUP BY 1",
)
def _(d):
    # the run that wrote the log is logged itself, with an error as long as the longest
    path = fresh_path(d.spark, "runs")
    OUT.append_runs(d.runs, path)
    longest = d.runs.agg(F.max(F.length("error"))).first()[0]
    began = dt.datetime(2001, 8, 2)
    OUT.append_run(d.spark, path, ("run-last", "job-log", "partial", began, "y" * longest), d.runs.schema)
    log = d.spark.read.parquet(path)
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.max(F.length("error")).cast("bigint").alias("longest_error"))


@query(
    "s17_forecast_payload",
    "node_weather",
    f"SELECT wx_id, lead_day, {hr('CASE WHEN lead_day = 3 THEN NULL ELSE temperature_c END', 6)} AS temperature_c, {hr('rh_pct', 6)} AS rh_pct"
    " FROM (SELECT wx_id, unnest(range(1, max(lead_day) + 1))::BIGINT AS lead_day FROM node_weather GROUP BY 1) LEFT JOIN node_weather USING (wx_id, lead_day)",
)
def _(d):
    # a place's arrays run to its last lead day; days it lacks are null in them
    known = F.map_from_entries(F.collect_list(F.struct("lead_day", F.struct(F.when(F.col("lead_day") != 3, F.col("temperature_c")).alias("t"), F.col("rh_pct").alias("h")))))
    places = d.node_weather.groupBy("wx_id").agg(known.alias("known"), F.max("lead_day").alias("last"))
    at = lambda c: F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("last").cast("bigint")), lambda i: F.element_at("known", i.cast(d.node_weather.schema["lead_day"].dataType))[c])
    daily = F.struct(at("t").alias("temperature_2m_max"), at("h").alias("relative_humidity_2m_min"))
    payload = F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"})
    got = IN.forecast_payload(places.select("wx_id", payload.alias("payload")))
    return rounded(got.select("wx_id", (F.col("lead_day") + 1).alias("lead_day"), "temperature_c", "rh_pct"), {"temperature_c": 6, "rh_pct": 6})


_PIX = f"floor(({DEM['north']}::DOUBLE - lat) / {DEM['step']}::DOUBLE)::BIGINT AS row, floor((lon - {DEM['west']}::DOUBLE) / {DEM['step']}::DOUBLE)::BIGINT AS col"


@query(
    "s18_raster_sampling",
    "locations raster",
    f"SELECT location_id, CASE WHEN (row + col) % 9 > 0 THEN value END AS value FROM (SELECT location_id, {_PIX} FROM locations) LEFT JOIN raster USING (row, col)",
)
def _(d):
    holed = d.raster.withColumn("value", F.when((F.col("row") + F.col("col")) % 9 > 0, F.col("value")).otherwise(-32767.0))
    return R.sample(d.locations, holed, **DEM, nodata=-32767.0).select("location_id", "value")


@query(
    "s19_road_vertices",
    "active_fires",
    "SELECT lat, lon FROM active_fires UNION ALL SELECT lat + 0.5::DOUBLE, lon + 0.25::DOUBLE FROM active_fires",
)
def _(d):
    a, b = F.array("lon", "lat"), F.array(F.col("lon") + 0.25, F.col("lat") + 0.5)
    odd = F.col("fire_id") % 2 == 1
    line, multi = F.to_json(F.array(a, b)), F.to_json(F.array(F.array(a), F.array(b)))
    text = F.concat(
        F.lit('{"features":[{"geometry":{"type":"'),
        F.when(odd, "LineString").otherwise("MultiLineString"),
        F.lit('","coordinates":'),
        F.when(odd, line).otherwise(multi),
        F.lit('},"properties":{}}]}'),
    )
    path = _written(d, d.active_fires.select(text.alias("value")), "roads", "text")
    return IN.road_vertices(IN.read_features(d.spark, path, per_line=True)).select("lat", "lon")


@query(
    "s20_parameter_files",
    "labels_t",
    f"SELECT bec_zone, max({S.case_map({z: v[0] for z, v in K.CALIBRATION_1KM.items()}, 'bec_zone')}) AS xgb_weight, max({S.case_map({z: v[1] for z, v in K.CALIBRATION_1KM.items()}, 'bec_zone')}) AS bias, count(*) AS rows FROM labels_t GROUP BY 1",
)
def _(d):
    path = fresh_path(d.spark, "params")
    OUT.write_parameters(parameter_frame(d.spark, K.CALIBRATION_1KM).fillna({"cnn_weight": 0.0}), path)
    params = IN.read_parameters(d.spark, path)
    return d.labels.join(F.broadcast(params), "bec_zone").groupBy("bec_zone").agg(F.max("xgb_weight").alias("xgb_weight"), F.max("bias").alias("bias"), F.count(F.lit(1)).alias("rows"))


@query(
    "s21_add_variables",
    "weather",
    f"SELECT a.cell_id, a.date::VARCHAR AS date, {hr('a.rh_pct', 6)} AS rh_pct, {hr('b.soil_moisture_2', 6)} AS soil_moisture_2 FROM weather a LEFT JOIN (SELECT * FROM weather WHERE month(date) < 7) b USING (cell_id, date)",
)
def _(d):
    base = d.weather.select("cell_id", "date", "rh_pct")
    extra = d.weather.where(F.month("date") < 7).select("cell_id", "date", F.lit(0.0).alias("rh_pct"), "soil_moisture_2")
    return rounded(IN.add_missing_variables(base, extra, ["cell_id", "date"]), {"rh_pct": 6, "soil_moisture_2": 6})


