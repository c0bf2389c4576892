"""Registered streams: T01-T07, run over what is there and compared with their batch meaning over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.registry import sqlx as S
from emberlake.registry.base import query, rounded
from emberlake.registry.domain import Domain, cte
from emberlake.session import fresh_path
from emberlake.streaming import moisture, state, windows
from emberlake.streaming.store import run_into

hr = S.hr


def _events(d, files_per_trigger: int | None = None):
    schema = d.table("events").schema
    return windows.file_stream(d.spark, f"{d.folder}/events.parquet", schema, files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def _ticks(d):
    flashes = F.when(F.col("event_type") == "error", F.lit(-1000.0)).otherwise(F.floor(F.col("value") / 50.0).cast("double"))
    return _events(d).select(Domain._user().alias("cell_id"), "ts", flashes.alias("flashes"))


@query(
    "t01_streamed_codes",
    "whole_rolled",
    "SELECT cell_id, date::VARCHAR AS date, " + ", ".join(f"{hr(c, 4)} AS {c}" for c in ("ffmc", "dmc", "dc")) + " FROM whole_rolled WHERE rn > 0",
)
def _(d):
    # ranges of dates, the latest first, half of the files to a batch: late days are folded in
    root = fresh_path(d.spark, "t01")
    days = d.weather.select("cell_id", "date", *moisture.DRIVERS)
    quarters = d.steps.agg(F.percentile_approx(F.unix_date(F.to_date("ts")), [0.75, 0.5, 0.25], 1000)).first()[0] or []
    day, above = F.unix_date("date"), F.lit(False)
    for low in quarters:  # a range is read, grouped and written by itself, which moves a day once
        days.where((day >= low) & ~above).write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
        above = day >= low
    days.where(~above | day.isNull()).write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
    files = len(d.spark.read.schema(days.schema).parquet(f"{root}/in").inputFiles())
    stream = windows.file_stream(d.spark, f"{root}/in", days.schema, files_per_trigger=-(-files // 2))
    got = run_into(stream, moisture.codes_table(f"{root}/work", buckets=4))
    return rounded(got.select("cell_id", "date", "ffmc", "dmc", "dc"), {"ffmc": 4, "dmc": 4, "dc": 4})


def _lightning(hours: int, name: str):
    @query(
        name,
        "ticks",
        f"SELECT cell_id, (h + to_hours(k::INT) - INTERVAL {hours - 1} HOUR)::VARCHAR AS window_start, sum(f)::DOUBLE AS flashes FROM (SELECT cell_id, date_trunc('hour', ts) AS h, sum(greatest(flashes, 0)) AS f FROM ticks GROUP BY 1, 2)"
        f" CROSS JOIN (SELECT unnest(range({hours})) AS k) GROUP BY 1, 2",
    )
    def _(d):
        hourly = run_into(_ticks(d), windows.lightning_table(fresh_path(d.spark, name), buckets=2))
        return windows.lightning_windows(hourly, hours).select("cell_id", "window_start", "flashes")


_lightning(24, "t02_lightning_24h")
_lightning(72, "t02_lightning_72h")


@query(
    "t03_daily_extremes",
    "hourly",
    f"SELECT cell_id, ts::DATE::VARCHAR AS date, {hr('max(temperature_k) - 273.15::DOUBLE', 6)} AS temperature_c, min(rh_pct) AS rh_pct, {hr('max(wind_ms) * 3.6::DOUBLE', 6)} AS wind_kmh,"
    " arg_max(wind_dir_deg, {'w': wind_ms, 't': -epoch_us(ts)}) AS wind_dir_deg, greatest(sum(precip_mm), 0) AS precip_24h_mm FROM hourly GROUP BY 1, 2",
)
def _(d):
    hourly = _events(d).select(*Domain.hourly_columns())
    got = windows.daily_extremes(run_into(hourly, windows.extremes_table(fresh_path(d.spark, "t03"), buckets=2)))
    return rounded(got, {"temperature_c": 6, "wind_kmh": 6})


cte("exceeded", "", "SELECT user_id AS alert_id, ts, value / 500.0::DOUBLE AS score FROM events WHERE value / 500.0::DOUBLE >= (user_id % 10) / 50.0::DOUBLE")
cte(
    "firings",
    "exceeded",
    "(SELECT alert_id, min(ts) AS ts FROM exceeded GROUP BY 1) UNION ALL (SELECT e.alert_id, min(e.ts) FROM firings f JOIN exceeded e ON e.alert_id = f.alert_id AND e.ts >= f.ts + INTERVAL 24 HOUR GROUP BY 1)",
)


@query("t04_cooled_alerts", "firings exceeded", "SELECT alert_id, ts::VARCHAR AS ts, min(score) AS score FROM firings JOIN exceeded USING (alert_id, ts) GROUP BY 1, 2", recursive=True)
def _(d):
    readings = _events(d).select(
        F.col("user_id").alias("alert_id"), "ts", (F.col("value") / 500.0).alias("score"), (F.col("user_id") % 10 / 50.0).alias("threshold")
    )
    return state.run_alerts(readings, fresh_path(d.spark, "t04"))


@query(
    "t05_streamed_usage",
    "",
    "SELECT user_id AS api_key, date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Vancouver')::DATE::VARCHAR AS day, count(*) AS used FROM events GROUP BY 1, 2",
)
def _(d):
    requests = _events(d).select(F.col("user_id").alias("api_key"), "ts")
    return run_into(requests, windows.usage_table(fresh_path(d.spark, "t05"), buckets=2))


@query(
    "t06_latest_snapshot",
    "ticks",
    "SELECT cell_id, max(ts)::VARCHAR AS run_ts FROM ticks WHERE ts > (SELECT max(ts) FROM ticks) - INTERVAL 48 HOUR GROUP BY 1",
)
def _(d):
    runs = _ticks(d).select("cell_id", F.col("ts").alias("run_ts"), F.col("flashes").alias("score"))
    return state.run_snapshot(runs, fresh_path(d.spark, "t06"), ["score"]).select("cell_id", "run_ts")


@query(
    "t07_risk_sessions",
    "ticks",
    "SELECT cell_id, min(ts)::VARCHAR AS session_start, (max(ts) + INTERVAL 25 HOUR)::VARCHAR AS session_end, count(*) AS records FROM (SELECT *, sum(fresh) OVER (PARTITION BY cell_id ORDER BY ts) AS s FROM"
    " (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY cell_id ORDER BY ts) + INTERVAL 25 HOUR THEN 0 ELSE 1 END AS fresh FROM ticks WHERE flashes >= 2)) GROUP BY cell_id, s",
)
def _(d):
    risky = _ticks(d).where(F.col("flashes") >= 2).select("cell_id", "ts", F.col("flashes").alias("score"))
    got = windows.risk_sessions(run_into(risky, windows.sessions_table(fresh_path(d.spark, "t07"))))
    return got.select("cell_id", "session_start", "session_end", "records")
