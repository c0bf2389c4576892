"""Registered aggregations: A01-A33."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake import constants as K
from emberlake.functions.geo import raster_col, raster_row
from emberlake.operators import firestats as FS
from emberlake.operators import metrics as M
from emberlake.operators import quality as Q
from emberlake.operators import raster as R
from emberlake.operators import sampling
from emberlake.operators import serving as V
from emberlake.operators import spatial as P
from emberlake.operators import temporal as T
from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import AS_OF_YEAR, cte

hr, br = S.hr, S.br
Y10, Y30 = AS_OF_YEAR - 10, AS_OF_YEAR - 30

# --- fire statistics as SQL --------------------------------------------------------------------------------
cte(
    "tiers",
    "cells fire_pairs",
    "SELECT c.*, coalesce(n10, 0) AS n10, near10, large10, coalesce(n30, 0) AS n30, near30, large30, coalesce(nall, 0) AS nall, near_all, large_all, record_start FROM cells c LEFT JOIN ("
    f"SELECT cell_id, count(*) FILTER (year >= {Y10}) AS n10, min(km) FILTER (year >= {Y10}) AS near10, max(size_ha) FILTER (year >= {Y10}) AS large10,"
    f" count(*) FILTER (year >= {Y30}) AS n30, min(km) FILTER (year >= {Y30}) AS near30, max(size_ha) FILTER (year >= {Y30}) AS large30,"
    " count(*) AS nall, min(km) AS near_all, max(size_ha) AS large_all, min(year) AS record_start FROM fire_pairs GROUP BY 1) USING (cell_id)",
)
cte("group_rates", "tiers", f"SELECT bec_zone, fuel_type, count(*) AS gcells, sum(n10) / (count(*) * {K.SEASON_DAYS_10YR}) AS grate FROM tiers GROUP BY 1, 2")
cte("zone_rates", "tiers", f"SELECT bec_zone, count(*) AS zcells, sum(n10) / (count(*) * {K.SEASON_DAYS_10YR}) AS zrate FROM tiers GROUP BY 1")
_INH = "(CASE WHEN gcells >= 10 THEN grate ELSE zrate END)"
_SRC = "(CASE WHEN gcells >= 10 THEN 'bec_fuel' ELSE 'bec' END)"
_CAP = f"(n10 = 0 AND {_INH} > zrate * 0.5::DOUBLE)"
cte(
    "suscept",
    "tiers group_rates zone_rates",
    f"SELECT t.*, CASE WHEN n10 >= 2 THEN n10 / {K.SEASON_DAYS_10YR}.0::DOUBLE WHEN {_CAP} THEN zrate * 0.5::DOUBLE ELSE {_INH} END AS susceptibility_score,"
    f" CASE WHEN n10 >= 2 THEN 'cell' WHEN {_CAP} THEN {_SRC} || '_dampened' ELSE {_SRC} END AS susceptibility_basis"
    " FROM tiers t JOIN group_rates USING (bec_zone, fuel_type) JOIN zone_rates USING (bec_zone)",
)
_PCT = lambda v: f"least({br(f'(rank() OVER (ORDER BY {v}) - 1) / count(*) OVER () * 100.0::DOUBLE', 0)}, 100)::BIGINT"
cte(
    "ranked",
    "suscept",
    f"SELECT *, {_PCT('susceptibility_score')} AS susceptibility_percentile, {_PCT('n10')} AS exposure_percentile FROM suscept",
)
cte("first_fire", "fires", "SELECT lat, lon, year, arg_min(size_ha, fire_id) AS size_ha, arg_min(cause, fire_id) AS cause FROM fires GROUP BY 1, 2, 3")
cte("zoned_fire", "first_fire envelope", "SELECT bec_zone, size_ha, cause FROM first_fire JOIN envelope ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max")
cte(
    "regime",
    "cells zoned_fire fires",
    f"SELECT a.bec_zone, a.area / (burned / (SELECT greatest({AS_OF_YEAR} - min(year), 1) FROM fires)) AS mean_return_years,"
    " CASE WHEN med > 1000 THEN 'high' WHEN med >= 100 THEN 'moderate' ELSE 'low' END AS typical_severity, coalesce(cause, 'unknown') AS dominant_cause"
    " FROM (SELECT bec_zone, count(*) * 100.0::DOUBLE AS area FROM cells GROUP BY 1) a LEFT JOIN (SELECT bec_zone, sum(size_ha) AS burned, median(size_ha) AS med FROM zoned_fire GROUP BY 1) USING (bec_zone)"
    " LEFT JOIN (SELECT bec_zone, arg_min(cause, {'n': -n, 'c': cause}) AS cause FROM (SELECT bec_zone, cause, count(*) AS n FROM zoned_fire GROUP BY 1, 2) GROUP BY 1) USING (bec_zone)",
)
cte("stats", "ranked regime", "SELECT * FROM ranked LEFT JOIN regime USING (bec_zone)")


def flat_tiers(df, *extra):
    return df.select(
        "cell_id",
        F.col("fires_10yr.count").alias("n10"),
        F.round("fires_10yr.nearest_km", 6).alias("near10"),
        F.col("fires_10yr.largest_ha").alias("large10"),
        F.col("fires_30yr.count").alias("n30"),
        F.round("fires_30yr.nearest_km", 6).alias("near30"),
        F.col("fires_all.count").alias("nall"),
        F.col("fires_all.largest_ha").alias("large_all"),
        F.col("record_start").cast("double").alias("record_start"),
        *extra,
    )


_FLAT = f"cell_id, n10, {hr('near10', 6)} AS near10, large10, n30, {hr('near30', 6)} AS near30, nall, large_all, record_start::DOUBLE AS record_start"


def _tiers(d):
    return FS.cell_tiers(d.cells, d.fires, AS_OF_YEAR)


@query("a01_fire_tiers", "tiers", f"SELECT {_FLAT} FROM tiers")
def _(d):
    return flat_tiers(_tiers(d))


@query(
    "a01_fire_causes",
    "fire_pairs",
    f"SELECT cell_id, cause, count(*) AS n FROM fire_pairs WHERE year >= {Y10} GROUP BY 1, 2",
)
def _(d):
    return _tiers(d).select("cell_id", F.explode("fires_10yr.causes").alias("cause", "n"))


@query(
    "a02_fire_rates",
    "group_rates zone_rates",
    f"SELECT bec_zone, coalesce(fuel_type, 'all') AS fuel_type, cells, {hr('rate', 9)} AS rate FROM (SELECT bec_zone, fuel_type, gcells AS cells, grate AS rate FROM group_rates UNION ALL SELECT bec_zone, NULL, zcells, zrate FROM zone_rates)",
)
def _(d):
    got = FS.fire_rates(_tiers(d))
    return got.select("bec_zone", F.when(F.col("is_zone") == 1, "all").otherwise(F.col("fuel_type")).alias("fuel_type"), "cells", F.round("rate", 9).alias("rate"))


@query("a03_susceptibility", "suscept", f"SELECT cell_id, {hr('susceptibility_score', 9)} AS susceptibility_score, susceptibility_basis FROM suscept")
def _(d):
    tiers = _tiers(d)
    got = FS.susceptibility(tiers, FS.fire_rates(tiers))
    return got.select("cell_id", F.round("susceptibility_score", 9).alias("susceptibility_score"), "susceptibility_basis")


@query("a04_fire_regime", "regime", f"SELECT bec_zone, {hr('mean_return_years', 5)} AS mean_return_years, typical_severity, dominant_cause FROM regime")
def _(d):
    return rounded(FS.fire_regime(d.cells, d.fires, AS_OF_YEAR), {"mean_return_years": 5})


@query(
    "a05_zone_summary",
    "scored_cells",
    f"SELECT bec_zone, {S.case_map(K.ZONE_NAMES, 'bec_zone')} AS zone_name, {hr('avg(score)', 3)} AS avg_score, {hr('max(score)', 3)} AS max_score, {S.level('avg(score)')} AS level,"
    " count(*) AS cell_count, count(*) FILTER (score >= 0.6::DOUBLE) AS high_risk_cells FROM scored_cells GROUP BY 1",
)
def _(d):
    return V.zone_summary(d.scored_cells)


@query(
    "a06_zone_drivers",
    "contribution_rows",
    f"SELECT bec_zone, cell_count, feature, rank, {hr('mean_abs', 6)} AS mean_abs FROM (SELECT bec_zone, feature, count(*) AS cell_count, avg(abs(c)) AS mean_abs,"
    " row_number() OVER (PARTITION BY bec_zone ORDER BY round(avg(abs(c)), 9) DESC, feature) AS rank FROM contribution_rows GROUP BY 1, 2) WHERE rank <= 5",
)
def _(d):
    return rounded(V.zone_drivers(d.explained, 5), {"mean_abs": 6})


@query(
    "a07_hourly_to_daily",
    "hourly",
    f"SELECT cell_id, ts::DATE::VARCHAR AS date, {hr('max(temperature_k) - 273.15::DOUBLE', 6)} AS temperature_c, min(rh_pct) AS rh_pct, {hr('max(wind_ms) * 3.6::DOUBLE', 6)} AS wind_kmh,"
    f" arg_max(wind_dir_deg, {{'w': wind_ms, 't': -epoch_us(ts)}}) AS wind_dir_deg, greatest(sum(precip_mm), 0) AS precip_24h_mm FROM hourly GROUP BY 1, 2",
)
def _(d):
    timed = d.hourly.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "date": F.to_date("ts")})
    return rounded(T.hourly_to_daily(timed, ["cell_id", "date"], "us"), {"temperature_c": 6, "wind_kmh": 6})


_LEAD = "ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE / 24)"


@query(
    "a08_lead_day",
    "hourly",
    f"SELECT cell_id, lead_day, source, max(temperature_k) AS temperature_k FROM (SELECT *, {_LEAD}::BIGINT AS lead_day, CASE WHEN epoch_us(ts) % 2 = 0 THEN 'HRDPS' ELSE 'GDPS' END AS source FROM hourly)"
    " WHERE (lead_day <= 2 AND source = 'HRDPS') OR (lead_day BETWEEN 3 AND 10 AND source = 'GDPS') GROUP BY 1, 2, 3",
)
def _(d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = (us - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3600000000.0
    lead = F.ceil(hour / 24.0).cast("int")
    rows = d.hourly.withColumns({"lead_day": lead, "source": F.when(us % 2 == 0, "HRDPS").otherwise("GDPS")})
    return T.by_source_precedence(rows).groupBy("cell_id", "lead_day", "source").agg(F.max("temperature_k").alias("temperature_k"))


@query(
    "a09_afternoon_mean",
    "hourly",
    f"SELECT cell_id, ts::DATE::VARCHAR AS date, {hr('avg(temperature_k)', 5)} AS temperature_k, avg(CASE WHEN precip_mm > 0 THEN rh_pct END) AS rh_pct FROM hourly WHERE hour(ts) BETWEEN 12 AND 18 GROUP BY 1, 2".replace(
        "avg(CASE WHEN precip_mm > 0 THEN rh_pct END)", hr("avg(CASE WHEN precip_mm > 0 THEN rh_pct END)", 6)
    ),
)
def _(d):
    levels = d.hourly.withColumn("rh_pct", F.when(F.col("precip_mm") > 0, F.col("rh_pct")))
    return rounded(T.afternoon_mean(levels, ["temperature_k", "rh_pct"]), {"temperature_k": 5, "rh_pct": 6})


@query(
    "a10_daily_mean",
    "weather",
    f"SELECT cell_id, date::VARCHAR AS date, {hr('temperature_c', 6)} AS temperature_c, {hr('rh_pct', 6)} AS rh_pct, {hr('precip_24h_mm', 6)} AS precip_24h_mm FROM weather",
)
def _(d):
    return rounded(d.weather.select("cell_id", "date", "temperature_c", "rh_pct", "precip_24h_mm"), {"temperature_c": 6, "rh_pct": 6, "precip_24h_mm": 6})


@query(
    "a11_trailing_lightning",
    "ticks",
    "SELECT cell_id, sum(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN greatest(flashes, 0) ELSE 0 END)::DOUBLE AS lightning_24h, sum(greatest(flashes, 0))::DOUBLE AS lightning_72h"
    " FROM ticks WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1",
)
def _(d):
    return T.trailing_flashes(d.ticks, F.lit("2024-01-16").cast("timestamp"))


@query(
    "a11_daily_lightning",
    "ticks",
    "SELECT cell_id, (ts::DATE + ago)::DATE::VARCHAR AS date, sum(CASE WHEN ago = 0 THEN greatest(flashes, 0) ELSE 0 END)::DOUBLE AS lightning_24h, sum(greatest(flashes, 0))::DOUBLE AS lightning_72h"
    " FROM ticks CROSS JOIN (SELECT unnest([0, 1, 2]) AS ago) GROUP BY 1, 2",
)
def _(d):
    return T.daily_flashes(d.ticks)


_ROW = f"least(greatest(floor(({K.RASTER_LAT[1]}::DOUBLE - lat) / {(K.RASTER_LAT[1] - K.RASTER_LAT[0]) / K.RASTER_H!r}::DOUBLE), 0), 255)::BIGINT"
_COL = f"least(greatest(floor((lon - {K.RASTER_LON[0]}::DOUBLE) / {(K.RASTER_LON[1] - K.RASTER_LON[0]) / K.RASTER_W!r}::DOUBLE), 0), 511)::BIGINT"
cte(
    "pixels",
    "stations weather",
    f"SELECT date, {_ROW} AS row, {_COL} AS col, avg(temperature_c) AS temperature_c, avg(rh_pct) AS rh_pct FROM weather JOIN stations USING (cell_id) GROUP BY 1, 2, 3",
)


def station_pixels(d):
    placed = d.stations.select("cell_id", raster_row(F.col("lat")).alias("row"), raster_col(F.col("lon")).alias("col"))
    rows = d.weather.select("cell_id", "date", "temperature_c", "rh_pct").join(placed, "cell_id")
    return R.rasterize(rows, ["temperature_c", "rh_pct"], ["date"])


@query("a12_rasterize", "pixels", f"SELECT date::VARCHAR AS date, row, col, {hr('temperature_c', 6)} AS temperature_c, {hr('rh_pct', 6)} AS rh_pct FROM pixels")
def _(d):
    return rounded(station_pixels(d), {"temperature_c": 6, "rh_pct": 6})


@query("a12_fire_mask", "fires", f"SELECT DISTINCT year, {_ROW} AS row, {_COL} AS col, 1::BIGINT AS fire FROM fires")
def _(d):
    placed = d.fires.select("year", raster_row(F.col("lat")).alias("row"), raster_col(F.col("lon")).alias("col"))
    return R.fire_mask(placed, ["year"])


@query(
    "a12_last_cell_raster",
    "scored_cells",
    f"SELECT floor(({K.LAT_MAX}::DOUBLE - lat) / {(K.LAT_MAX - K.LAT_MIN) / 180!r}::DOUBLE)::BIGINT AS row, floor((lon - {K.LON_MIN}::DOUBLE) / {(K.LON_MAX - K.LON_MIN) / 260!r}::DOUBLE)::BIGINT AS col, arg_max(score, cell_id) AS score"
    " FROM scored_cells GROUP BY 1, 2",
)
def _(d):
    return R.last_cell_raster(d.scored_cells, "score", 180, 260, K.LAT_MAX, K.LAT_MIN, K.LON_MIN, K.LON_MAX)


_LAND = f"(SELECT DISTINCT {_ROW} AS row, {_COL} AS col FROM stations)"


@query(
    "a13_channel_stats",
    "pixels stations",
    f"SELECT channel, {hr('s / n', 6)} AS mean, {hr('sqrt(greatest(q / n - (s / n) * (s / n), 0))', 6)} AS std FROM (SELECT 'temperature_c' AS channel, sum(temperature_c) AS s, sum(temperature_c * temperature_c) AS q FROM pixels WHERE year(date) <= 1999"
    f" UNION ALL SELECT 'rh_pct', sum(rh_pct), sum(rh_pct * rh_pct) FROM pixels WHERE year(date) <= 1999)"
    f" CROSS JOIN (SELECT (SELECT count(*) FROM {_LAND}) * (SELECT count(DISTINCT date) FROM pixels WHERE year(date) <= 1999)::DOUBLE AS n)",
)
def _(d):
    land = d.stations.select(raster_row(F.col("lat")).alias("row"), raster_col(F.col("lon")).alias("col"))
    return rounded(R.channel_stats(station_pixels(d), land, ["temperature_c", "rh_pct"], 1999), {"mean": 6, "std": 6})


# --- model quality as SQL -----------------------------------------------------------------------------------


def eval_sql(rows: str, keys: str = "", p: str = "p") -> str:
    """Metrics of ``rows`` (y, score) per key list, by definitions rather than by histogram."""
    by = f"PARTITION BY {keys}" if keys else ""
    g = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    f1 = ", ".join(
        f"{{'f1': coalesce(2 * count(*) FILTER ({p} >= {t!r}::DOUBLE AND y = 1) / nullif(count(*) FILTER ({p} >= {t!r}::DOUBLE) + sum(y), 0)::DOUBLE, 0), 'nt': {-t!r}::DOUBLE}}" for t in K.F1_THRESHOLDS
    )
    edges = " + ".join(f"({p} >= {e!r}::DOUBLE)::INT" for e in M.BIN_EDGES)
    ranked = (
        f"SELECT *, rank() OVER ({by} ORDER BY {p}) AS lo, count(*) OVER ({by} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,"
        f" sum(y) OVER ({by} ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, count(*) OVER ({by} ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM ({rows})"
    )
    main = (
        f"SELECT {g}(sum(CASE WHEN y = 1 THEN (lo + hi) / 2.0::DOUBLE END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc_roc,"
        f" sum(CASE WHEN y = 1 THEN tp / k::DOUBLE END) / nullif(sum(y), 0) AS pr_auc, avg(pow({p} - y, 2)) AS brier_score,"
        f" avg(-(y * ln(greatest({p}, 1e-15)) + (1 - y) * ln(greatest(1 - least({p}, 1 - 1e-15), 1e-15)))) AS log_loss, list_max([{f1}]) AS best, count(*) AS n_samples, sum(y)::BIGINT AS n_positive FROM ({ranked}) {grp}"
    )
    ece = (
        f"SELECT {g}sum(abs(sp - sy)) AS gap FROM (SELECT {g}{edges} - 1 AS bin, sum({p}) AS sp, sum(y) AS sy FROM ({rows}) GROUP BY ALL) WHERE bin BETWEEN 0 AND 9 {grp}"
    )
    return (
        f"SELECT {g}auc_roc, pr_auc, brier_score, log_loss, coalesce(gap, 0) / n_samples AS ece, best.f1 AS best_f1, CASE WHEN best.f1 > 0 THEN round(-best.nt, 2) ELSE 0.5 END AS best_threshold, n_samples, n_positive"
        f" FROM ({main}) LEFT JOIN ({ece}) {using}"
    )


cte("eval_all", "labels_t", eval_sql("SELECT y, p FROM labels_t"))
cte("eval_zone", "labels_t", eval_sql("SELECT bec_zone, y, p FROM labels_t", "bec_zone"))
cte("eval_zone_q", "labels_t", eval_sql("SELECT bec_zone, y, q AS p FROM labels_t", "bec_zone"))
cte("eval_year", "labels_t", eval_sql("SELECT year, y, p FROM labels_t", "year"))
cte("eval_q", "labels_t", eval_sql("SELECT y, q AS p FROM labels_t"))


@query("a14_auc_roc", "eval_all", f"SELECT {hr('auc_roc', 6)} AS auc_roc FROM eval_all")
def _(d):
    return rounded(M.evaluate(d.labels).select("auc_roc"), {"auc_roc": 6})


@query("a15_average_precision", "eval_all", f"SELECT {hr('pr_auc', 6)} AS pr_auc FROM eval_all")
def _(d):
    return rounded(M.evaluate(d.labels).select("pr_auc"), {"pr_auc": 6})


@query("a16_brier_log_loss", "eval_all", f"SELECT {hr('brier_score', 6)} AS brier_score, {hr('log_loss', 6)} AS log_loss FROM eval_all")
def _(d):
    return rounded(M.evaluate(d.labels).select("brier_score", "log_loss"), {"brier_score": 6, "log_loss": 6})


@query("a17_calibration_error", "eval_zone", f"SELECT bec_zone, {hr('ece', 6)} AS ece FROM eval_zone")
def _(d):
    return rounded(M.evaluate(d.labels, keys=["bec_zone"]).select("bec_zone", "ece"), {"ece": 6})


_EDGES = " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in M.BIN_EDGES)


@query(
    "a18_calibration_curve",
    "labels_t",
    f"SELECT b.bin, {hr('coalesce(m, (b.bin + 0.5::DOUBLE) / 10)', 6)} AS predicted_mean, {hr('coalesce(f, 0)', 6)} AS actual_fraction, coalesce(n, 0) AS count"
    f" FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT {_EDGES} - 1 AS bin, avg(p) AS m, avg(y) AS f, count(*) AS n FROM labels_t GROUP BY 1) g USING (bin)",
)
def _(d):
    return rounded(M.calibration_curve(d.labels), {"predicted_mean": 6, "actual_fraction": 6})


@query(
    "a19_threshold_metrics",
    "labels_t",
    "SELECT bec_zone, threshold, tp, fp, fn, tn, "
    + hr("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", 6)
    + " AS precision, "
    + hr("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", 6)
    + " AS recall, "
    + hr("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", 6)
    + " AS f1 FROM (SELECT bec_zone, t::DOUBLE AS threshold, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p < t AND y = 0) AS tn"
    " FROM labels_t CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS t) GROUP BY 1, 2)",
)
def _(d):
    got = M.evaluate(d.labels, keys=["bec_zone"]).select("bec_zone", F.inline("thresholds"))
    return rounded(got, {"precision": 6, "recall": 6, "f1": 6})


@query("a20_best_f1", "eval_zone", f"SELECT bec_zone, {hr('best_f1', 6)} AS best_f1, best_threshold::DOUBLE AS best_threshold FROM eval_zone")
def _(d):
    return rounded(M.evaluate(d.labels, keys=["bec_zone"]).select("bec_zone", "best_f1", "best_threshold"), {"best_f1": 6})


_M6 = ", ".join(f"{hr(m, 6)} AS {m}" for m in M.METRICS)


@query("a21_zone_evaluation", "eval_zone", f"SELECT bec_zone, {_M6}, n_samples, n_positive FROM eval_zone WHERE n_samples >= 50 AND n_positive > 0 AND n_positive < n_samples")
def _(d):
    got = M.evaluate_zones(d.labels)
    return rounded(got.select("bec_zone", *M.METRICS, "n_samples", "n_positive"), {m: 6 for m in M.METRICS})


_DELTA = ", ".join(f"{hr(f'{hr("b." + m, 4)} - {hr("a." + m, 4)}', 4)} AS delta_{m}" for m in M.METRICS)


@query("a22_compare_models", "eval_zone eval_zone_q", f"SELECT a.bec_zone, {_DELTA} FROM eval_zone a JOIN eval_zone_q b USING (bec_zone)")
def _(d):
    got = M.compare_scores(d.labels, "p", "q", keys=["bec_zone"])
    return got.select("bec_zone", *[f"delta_{m}" for m in M.METRICS])


_REP = ", ".join(f"{hr(f'avg({m})', 6)} AS {m}_mean, {hr(f'stddev_pop({m})', 6)} AS {m}_std" for m in M.METRICS)


@query("a23_backtest_report", "eval_year", f"SELECT count(*) AS years, {_REP}, sum(n_samples)::BIGINT AS n_samples, sum(n_positive)::BIGINT AS n_positive FROM eval_year")
def _(d):
    got = M.backtest_report(M.evaluate(d.labels, keys=["year"]))
    return rounded(got, {f"{m}_{s}": 6 for m in M.METRICS for s in ("mean", "std")})


@query(
    "a24_drift_check",
    "eval_year eval_all",
    "SELECT a.year, concat_ws(',', CASE WHEN a.auc_roc < 0.85 THEN 'auc_below_threshold' END, CASE WHEN a.ece > 0.05 THEN 'calibration_error_above_threshold' END,"
    " CASE WHEN b.auc_roc > 0 AND a.auc_roc < b.auc_roc * 0.95 THEN 'auc_dropped_from_baseline' END) AS alerts, (a.auc_roc < 0.85 OR a.ece > 0.05 OR a.auc_roc < b.auc_roc * 0.95)::BIGINT AS drift_detected FROM eval_year a CROSS JOIN eval_all b",
)
def _(d):
    base = M.evaluate(d.labels).select("auc_roc").scalar()
    got = M.drift_alerts(M.evaluate(d.labels, keys=["year"]).withColumn("_base", base), F.col("_base"))
    return got.select("year", F.array_join("alerts", ",").alias("alerts"), "drift_detected")


@query(
    "a25_season_hits",
    "fire_days weather",
    "SELECT count(*) AS fire_days, sum(hit)::BIGINT AS hits, " + hr("avg(hit)", 3) + " AS hit_rate FROM (SELECT coalesce((rh_pct / 100 > 0.3)::INT, 0) AS hit FROM fire_days LEFT JOIN weather USING (cell_id, date))",
)
def _(d):
    scored = d.weather.select("cell_id", "date", (F.col("rh_pct") / 100).alias("score"))
    return M.season_hits(P.assign_fires(d.fires, d.stations), scored)


@query(
    "a27_class_balance",
    "labels_t",
    "SELECT sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, " + hr("sum(1 - y) / greatest(sum(y), 1)", 6) + " AS scale_pos_weight FROM labels_t",
)
def _(d):
    return rounded(sampling.class_balance(d.labels, "y"), {"scale_pos_weight": 6})


@query("a28_feature_importance", "contribution_rows", f"SELECT feature, {hr('avg(abs(c))', 6)} AS importance FROM contribution_rows GROUP BY 1")
def _(d):
    return rounded(V.feature_importance(d.explained), {"importance": 6})


cte("found_months", "steps", "SELECT date_trunc('month', ts)::DATE AS month_start, count(*) AS rows FROM steps GROUP BY 1")


@query(
    "a29_month_report",
    "found_months",
    "SELECT count(*) AS expected, count(rows) AS found, count(*) FILTER (rows IS NULL) AS missing, count(*) FILTER (rows < 600) AS too_small,"
    " CASE WHEN count(*) FILTER (rows IS NULL) > 12 THEN 'fail' WHEN count(*) FILTER (rows IS NULL OR rows < 600) > 0 THEN 'partial' ELSE 'pass' END AS status"
    " FROM (SELECT unnest(generate_series(DATE '1994-06-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month_start) LEFT JOIN found_months USING (month_start)",
)
def _(d):
    found = d.steps.groupBy(F.trunc(F.to_date("ts"), "month").alias("month_start")).agg(F.count(F.lit(1)).alias("rows"))
    return Q.month_report(d.spark, found, "1994-06-01", "2001-12-01", 600)


@query(
    "a29_value_report",
    "hourly",
    "SELECT 'temperature_k' AS variable, 100.0::DOUBLE AS valid_pct, min(temperature_k) AS min_value, max(temperature_k) AS max_value, CASE WHEN max(temperature_k) > 300.5 OR min(temperature_k) < 259.5 THEN 'out_of_range' ELSE 'ok' END AS issue FROM hourly"
    " UNION ALL SELECT 'rh_pct', " + hr("count(x) * 100.0::DOUBLE / count(*)", 6) + ", min(x), max(x), CASE WHEN count(x) * 100.0 / count(*) < 10 THEN 'few_valid' WHEN max(x) > 100.5 THEN 'out_of_range' ELSE 'ok' END FROM (SELECT CASE WHEN wind_ms > 14 THEN rh_pct END AS x FROM hourly)",
)
def _(d):
    rows = d.hourly.withColumn("rh_pct", F.when(F.col("wind_ms") > 14, F.col("rh_pct")))
    return rounded(Q.value_report(rows, {"temperature_k": (260.0, 300.0), "rh_pct": (0.0, 100.0)}), {"valid_pct": 6})


@query("a29_source_report", "fires", "SELECT source, count(*) AS records, count(DISTINCT date) AS fire_days, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date FROM fires GROUP BY 1")
def _(d):
    return Q.source_report(d.fires)


@query("a30_area_features", "scored_cells", f"SELECT cell_id, lon, lat, score, {S.level('score')} AS level FROM scored_cells WHERE lat BETWEEN 50 AND 55 AND lon BETWEEN -130 AND -118")
def _(d):
    picked = V.risk_grid(d.scored_cells, "50,-130,55,-118")
    text = V.as_features(picked, ["cell_id", "score", "level"])
    shape = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<cell_id:string,score:double,level:string>>"
    f = F.from_json("feature", shape)
    return text.select("cell_id", f["geometry"]["coordinates"][0].alias("lon"), f["geometry"]["coordinates"][1].alias("lat"), f["properties"]["score"].alias("score"), f["properties"]["level"].alias("level"))


@query(
    "a31_distinct_counts",
    "fires cells",
    "SELECT count(*) AS fires, count(DISTINCT source) AS sources, count(DISTINCT date) AS fire_days, count(DISTINCT cause) AS causes FROM fires",
)
def _(d):
    return d.fires.agg(
        F.count(F.lit(1)).alias("fires"), F.count_distinct("source").alias("sources"), F.count_distinct("date").alias("fire_days"), F.count_distinct("cause").alias("causes")
    )


@query(
    "a32_usage",
    "",
    "SELECT user_id AS api_key, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Vancouver')::DATE::VARCHAR AS day, count(*) AS used, greatest(3 - count(*), 0) AS remaining, (count(*) > 3)::BIGINT AS exceeded FROM events GROUP BY 1, 2",
)
def _(d):
    requests = d.table("events").select(F.col("user_id").alias("api_key"), F.col("ts").cast("timestamp").alias("ts"))
    return T.usage_per_day(requests, limit=3)


_SCENE = "SELECT l_partkey // 50 AS row, l_partkey % 50 AS col, l_shipdate::DATE AS date, avg(round(l_discount * 100)) / 10 AS ndvi, avg(l_quantity) AS lai, max(round(l_tax * 100)) AS snow FROM lineitem GROUP BY ALL"


def _scenes(d):
    k = F.col("l_partkey")
    return d.table("lineitem").groupBy(F.floor(k / 50).cast("bigint").alias("row"), (k % 50).alias("col"), F.to_date("l_shipdate").alias("date")).agg(
        (F.avg(F.round(F.col("l_discount") * 100)) / 10).alias("ndvi"), F.avg("l_quantity").alias("lai"), F.max(F.round(F.col("l_tax") * 100)).alias("snow")
    )


@query("a33_annual_composites", "", f"SELECT row, col, year(date) AS year, {hr('median(ndvi)', 6)} AS ndvi, {hr('median(lai)', 6)} AS lai, max(snow) AS snow FROM ({_SCENE}) GROUP BY 1, 2, 3")
def _(d):
    return rounded(R.annual_composites(_scenes(d)), {"ndvi": 6, "lai": 6})


@query(
    "a33_fine_ndvi",
    "",
    f"SELECT row, col, year, {hr('(b8 - b4) / nullif(b8 + b4, 0)', 9)} AS ndvi FROM (SELECT row, col, year(date) AS year, median(lai) AS b8, median(ndvi) AS b4 FROM ({_SCENE}) WHERE snow * 5 < 20 AND strftime(date, '%m-%d') BETWEEN '05-01' AND '09-29' GROUP BY 1, 2, 3)",
)
def _(d):
    bands = _scenes(d).select("row", "col", "date", F.col("lai").alias("b8"), F.col("ndvi").alias("b4"), (F.col("snow") * 5).alias("cloud_pct"))
    return rounded(R.fine_ndvi(bands).select("row", "col", "year", "ndvi"), {"ndvi": 9})
