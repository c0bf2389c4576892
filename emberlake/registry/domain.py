"""The given tables seen as domain tables, in Spark and as SQL for the oracle.

Customers are grid cells, orders fires and prediction records, suppliers weather
stations, line items weather steps, scenes and scored labels, parts raster pixels,
events ticks and requests. Values come from integer arithmetic on the keys so that
every engine gets the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlake import constants as K
from emberlake.functions.score import fuel_of, zone_of
from emberlake.registry import sqlx as S
from emberlake.session import fresh_path

AS_OF_YEAR = 2009
DAY = "2001-07-15"
NOW = "2001-08-02 00:00:00"
N_NODES = K.WEATHER_ROWS * K.WEATHER_COLS
DEM = {"north": 60.0, "west": -139.0, "step": 0.5}
SOILS = [f"soil_moisture_{i}" for i in range(1, 5)]
OBSERVED = ["temperature_c", "rh_pct", "wind_kmh", "wind_dir_deg", "precip_24h_mm", "evapotrans_mm", *SOILS]
RAW = ["q_t", "q_h", "q_w", "q_d", "q_r", "q_e", "q_s"]


def _mod(key: Column, a: int, m: int) -> Column:
    return (key * a) % m


def _static(k: Column) -> dict[str, Column]:
    return {
        "elevation_m": _mod(k, 37, 2600).cast("double"),
        "slope_deg": _mod(k, 13, 450) / 10.0,
        "aspect_deg": _mod(k, 29, 360).cast("double"),
        "hillshade": _mod(k, 17, 256).cast("double"),
        "distance_to_road_km": _mod(k, 11, 2000) / 10.0,
    }


def _placed(df: DataFrame, key: str, prefix: str, a: int, b: int) -> DataFrame:
    k = F.col(key)
    cells = df.select(
        F.concat(F.lit(prefix), F.lpad(k.cast("string"), 7, "0")).alias("cell_id"),
        k.alias("k"),
        (F.lit(48.4) + _mod(k, a, 11500) / 1000.0).alias("lat"),
        (F.lit(-138.9) + _mod(k, b, 24700) / 1000.0).alias("lon"),
        *[c.alias(n) for n, c in _static(k).items()],
    )
    zoned = cells.withColumn("bec_zone", zone_of(F.col("lat"), F.col("lon"), F.col("elevation_m")))
    return zoned.withColumn("fuel_type", fuel_of(F.col("bec_zone")))


class Domain:
    """Lazy domain frames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        return _placed(self.table("customer"), "c_custkey", "BC-5K-", 7919, 6007)

    @cached_property
    def stations(self) -> DataFrame:
        return _placed(self.table("supplier"), "s_suppkey", "WX-", 3571, 9343)

    @cached_property
    def fires(self) -> DataFrame:
        k = F.col("o_orderkey")
        first = F.substring("o_orderpriority", 1, 1)
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            k.alias("fire_id"),
            (F.lit(48.4) + _mod(k, 5381, 11503) / 1000.0).alias("lat"),
            (F.lit(-138.9) + _mod(k, 7907, 24709) / 1000.0).alias("lon"),
            F.to_date("o_orderdate").alias("date"),
            F.year("o_orderdate").alias("year"),
            (F.col("o_totalprice") / 100.0).alias("size_ha"),
            F.when(first.isin("1", "2"), "lightning").when(first.isin("3", "4"), "human").otherwise("unknown").alias("cause"),
            F.when(status == "F", "cnfdb").when(status == "O", "bc_incidents").otherwise("bc_perimeters").alias("source"),
        )

    @cached_property
    def steps(self) -> DataFrame:
        """Sub-daily steps in whole numbers, by station."""
        return self._steps()

    def _steps(self, *more: Column) -> DataFrame:
        ok = F.col("l_orderkey")
        return self.table("lineitem").select(
            F.concat(F.lit("WX-"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0")).alias("cell_id"),
            "l_partkey",
            "l_linenumber",
            F.col("l_shipdate").alias("ts"),
            (F.col("l_quantity") - 10.0).alias("q_t"),
            (F.round(F.col("l_discount") * 100.0) * 8.0 + 15.0).alias("q_h"),
            (F.col("l_partkey") * 7 % 60).cast("double").alias("q_w"),
            (F.col("l_partkey") * 53 % 360).cast("double").alias("q_d"),
            F.when(F.col("l_linenumber") <= 2, ok % 25).otherwise(0).cast("double").alias("q_r"),
            F.round(F.col("l_tax") * 100.0).alias("q_e"),
            (ok * 3 % 40 + 5).cast("double").alias("q_s"),
            *more,
        )

    @staticmethod
    def physical(df: DataFrame) -> DataFrame:
        """Means of whole numbers to weather columns."""
        others = [c for c in df.columns if c not in RAW]
        return df.select(
            *others,
            F.col("q_t").alias("temperature_c"),
            F.col("q_h").alias("rh_pct"),
            F.col("q_w").alias("wind_kmh"),
            F.col("q_d").alias("wind_dir_deg"),
            F.col("q_r").alias("precip_24h_mm"),
            F.col("q_e").alias("evapotrans_mm"),
            *[((F.col("q_s") + 3.0 * i) / 100.0).alias(s) for i, s in enumerate(SOILS)],
        )

    @cached_property
    def weather(self) -> DataFrame:
        from emberlake.operators.temporal import daily_mean

        return self.physical(daily_mean(self.steps, RAW))

    @cached_property
    def labelled_weather(self) -> DataFrame:
        """``weather`` with the label ``fire`` of each station day: both come from the same rows, so one grouping makes them."""
        from emberlake.operators.temporal import daily_mean

        steps = self._steps((F.col("l_returnflag") == "R").cast("int").alias("fire"))
        known = steps.where(F.col("cell_id").isNotNull() & F.col("ts").isNotNull())
        return self.physical(daily_mean(known, RAW, more=[F.max("fire").alias("fire")]))

    @cached_property
    def node_weather(self) -> DataFrame:
        """Forecast of the coarse grid: one row per (node, lead day)."""
        nodes = self.steps.groupBy((F.col("l_partkey") % N_NODES).alias("wx_id"), F.col("l_linenumber").alias("lead_day"))
        return self.physical(nodes.agg(*[F.avg(c).alias(c) for c in RAW]))

    @cached_property
    def history(self) -> DataFrame:
        """Prediction records: one per (cell, day)."""
        day = F.to_date("o_orderdate").alias("date")
        rows = self.table("orders").groupBy(F.col("o_custkey").alias("k"), day).agg((F.max("o_totalprice") / 500000.0).alias("score"))
        return rows.select(F.concat(F.lit("BC-5K-"), F.lpad(F.col("k").cast("string"), 7, "0")).alias("cell_id"), "date", "score")

    @cached_property
    def predictions(self) -> DataFrame:
        from emberlake.operators.serving import latest

        return latest(self.history, ["score"], run="date")

    @cached_property
    def scored_cells(self) -> DataFrame:
        from emberlake.operators.skew import dealt

        return self.cells.join(dealt(self.predictions.select("cell_id", "score")), "cell_id")

    @cached_property
    def labels(self) -> DataFrame:
        """Scored labels; a third of them in one zone."""
        ok, pk, ln, sk = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"))
        y = (F.col("l_returnflag") == "R").cast("int")
        zones = F.array(*[F.lit(z) for z in K.ZONES])
        at = (pk % 21).cast("int")
        return self.table("lineitem").select(
            ok.alias("row_a"),
            pk.alias("row_b"),
            ln.alias("row_c"),
            F.to_date("l_shipdate").alias("date"),
            F.year("l_shipdate").alias("year"),
            y.alias("y"),
            (((ok * 31 + pk * 17 + ln * 7) % 701 + y * (sk * 13 % 301)) / 1000.0).alias("p"),
            (((ok * 29 + pk * 23 + ln * 11) % 801 + y * (sk * 19 % 201)) / 1000.0).alias("q"),
            F.when(at < 14, F.element_at(zones, at + 1)).otherwise("IDF").alias("bec_zone"),
        )

    @cached_property
    def raster(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            F.floor(k / 50).cast("bigint").alias("row"), (k % 50).alias("col"), F.col("p_retailprice").alias("value")
        )

    @cached_property
    def ticks(self) -> DataFrame:
        flashes = F.when(F.col("event_type") == "error", F.lit(-1000.0)).otherwise(F.floor(F.col("value") / 50.0).cast("double"))
        return self.table("events").select(self._user().alias("cell_id"), "ts", flashes.alias("flashes"))

    @staticmethod
    def _user() -> Column:
        return F.concat(F.lit("WX-"), F.lpad(F.col("user_id").cast("string"), 7, "0"))

    @staticmethod
    def hourly_columns() -> list[Column]:
        e = F.col("event_id")
        return [
            Domain._user().alias("cell_id"),
            F.col("ts"),
            (e * 7 % 400 / 10.0 + 270.0).alias("temperature_k"),
            (e * 11 % 80 + 20).cast("double").alias("rh_pct"),
            (e * 13 % 150 / 10.0).alias("wind_ms"),
            (e * 53 % 360).cast("double").alias("wind_dir_deg"),
            F.when(F.col("event_type") == "view", e % 16 / 8.0).otherwise(0.0).alias("precip_mm"),
        ]

    @cached_property
    def hourly(self) -> DataFrame:
        return self.table("events").select(*self.hourly_columns())

    @cached_property
    def alerts(self) -> DataFrame:
        k = F.col("c_custkey")
        base = F.lit("2001-07-29 00:00:00").cast("timestamp")
        return self.table("customer").select(
            k.alias("alert_id"),
            self.api_key(k).alias("api_key"),
            F.concat(F.lit("BC-5K-"), F.lpad(k.cast("string"), 7, "0")).alias("cell_id"),
            (k * 13 % 100 / 100.0).alias("threshold"),
            self.url(k).alias("webhook_url"),
            (k % 5 != 0).alias("is_active"),
            (k % 5).cast("int").alias("consecutive_failures"),
            F.lit(None).cast("string").alias("disabled_reason"),
            F.when(k % 4 != 0, F.timestamp_seconds(F.unix_seconds(base) + (k * 7 % 144) * 3600)).alias("last_triggered"),
            F.timestamp_seconds(F.unix_seconds(F.lit("2001-01-01 00:00:00").cast("timestamp")) + (k % 240) * 86400).alias("created_at"),
        )

    @staticmethod
    def api_key(k: Column) -> Column:
        """A third of everything belongs to key 0."""
        return F.when(k % 3 == 0, F.lit(0).cast("bigint")).otherwise(k % 997 + 1)

    @staticmethod
    def url(k: Column) -> Column:
        return F.element_at(F.array(*[F.lit(u) for u in URLS]), (k % len(URLS)).cast("int") + 1)

    @cached_property
    def requests(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            k.alias("request_id"),
            self.api_key(c).alias("api_key"),
            F.concat(F.lit("BC-5K-"), F.lpad(c.cast("string"), 7, "0")).alias("cell_id"),
            (k % 2 * 0.5 + c * 13 % 100 / 200.0).alias("threshold"),
            self.url(c).alias("webhook_url"),
        )

    @cached_property
    def locations(self) -> DataFrame:
        """Asked places: one per order, a few outside the covered area."""
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("location_id"),
            (F.lit(48.0) + _mod(k, 4271, 12300) / 1000.0).alias("lat"),
            (F.lit(-139.4) + _mod(k, 3307, 25700) / 1000.0).alias("lon"),
        )

    @cached_property
    def properties(self) -> DataFrame:
        k = F.col("c_custkey")
        value = F.when(k % 9 != 0, F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100.0)
        return self.table("customer").select(
            k.alias("property_id"),
            (F.lit(48.2) + _mod(k, 6173, 11900) / 1000.0).alias("lat"),
            (F.lit(-139.1) + _mod(k, 4421, 25100) / 1000.0).alias("lon"),
            value.alias("value_cad"),
        )

    @cached_property
    def active_fires(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("fire_id"),
            (F.lit(48.4) + _mod(k, 8123, 11503) / 1000.0).alias("lat"),
            (F.lit(-138.9) + _mod(k, 5077, 24709) / 1000.0).alias("lon"),
            F.col("s_acctbal").alias("size_ha"),
        )

    @cached_property
    def explained(self) -> DataFrame:
        """Cells with contributions and values of the 28 features."""
        k = F.col("k")
        pairs, values = [], []
        for j, name in enumerate(K.FEATURES):
            pairs += [F.lit(name), ((k * ((j + 3) * 97) + j * j * 31) % 2001 - 1000) / 1000.0]
            values += [F.lit(name), k * ((j + 5) * 13) % 1000 / 10.0]
        return self.scored_cells.withColumns({"contributions": F.create_map(*pairs), "feature_values": F.create_map(*values)})

    @cached_property
    def runs(self) -> DataFrame:
        """Run log: one row per order."""
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("run-"), F.lpad(k.cast("string"), 9, "0")).alias("run_id"),
            F.concat(F.lit("job-"), (F.col("o_custkey") % 50).cast("string")).alias("job"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("started_at"),
            F.repeat(F.lit("x"), (k % 1500).cast("int")).alias("error"),
        )

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that the product keeps between questions: written once per application and folder, then read."""
        at = (self.spark.sparkContext.applicationId, self.folder, name)
        if at not in _STORED:
            path, rows = fresh_path(self.spark, name), build()
            rows.write.parquet(path)
            _STORED[at] = path, rows.schema
        path, schema = _STORED[at]
        return self.spark.read.schema(schema).parquet(path)

    def statistics(self) -> DataFrame:
        """The long-term statistics, worked out from cells and fires."""
        from emberlake.operators.firestats import fire_statistics

        return fire_statistics(self.cells, self.fires, AS_OF_YEAR)

    @property
    def stats(self) -> DataFrame:
        """The stored statistics table that the questions about places read."""
        return self.stored("fire-stats", self.statistics)

    @property
    def carried(self) -> DataFrame:
        """The stored codes of each station before ``DAY``, from its whole history."""
        from emberlake.operators.temporal import final_state, fold_codes

        before = self.weather.where(F.col("date") < F.lit(DAY).cast("date"))
        return self.stored("carried-codes", lambda: final_state(fold_codes(before, reset="none")))


#: Paths and columns of stored tables by application, folder and name.
_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}

URLS = [
    "https://hooks.example.com/a",
    "https://hooks.example.com/b?x=1",
    "http://hooks.example.com/plain",
    "https://localhost/x",
    "https://10.1.2.3/x",
    "https://172.20.0.9/x",
    "https://172.32.0.9/x",
    "https://192.168.4.4/x",
    "https://8.8.8.8/x",
    "https://printer.local/x",
    "https://db.internal/x",
    "https://api.example.org:8443/y",
]


def _placed_sql(table: str, key: str, prefix: str, a: int, b: int) -> str:
    inner = (
        f"SELECT '{prefix}' || lpad({key}::VARCHAR, 7, '0') AS cell_id, {key} AS k, 48.4::DOUBLE + ({key} * {a} % 11500) / 1000.0::DOUBLE AS lat,"
        f" -138.9::DOUBLE + ({key} * {b} % 24700) / 1000.0::DOUBLE AS lon, ({key} * 37 % 2600)::DOUBLE AS elevation_m,"
        f" ({key} * 13 % 450) / 10.0::DOUBLE AS slope_deg, ({key} * 29 % 360)::DOUBLE AS aspect_deg, ({key} * 17 % 256)::DOUBLE AS hillshade,"
        f" ({key} * 11 % 2000) / 10.0::DOUBLE AS distance_to_road_km FROM {table}"
    )
    zoned = f"SELECT *, {S.zone('lat', 'lon', 'elevation_m')} AS bec_zone FROM ({inner})"
    return f"SELECT *, {S.case_map(K.ZONE_FUEL, 'bec_zone', chr(39) + 'C3' + chr(39))} AS fuel_type FROM ({zoned})"


_PHYS = (
    "q_t AS temperature_c, q_h AS rh_pct, q_w AS wind_kmh, q_d AS wind_dir_deg, q_r AS precip_24h_mm, q_e AS evapotrans_mm, "
    + ", ".join(f"(q_s + {3.0 * i}::DOUBLE) / 100.0::DOUBLE AS {s}" for i, s in enumerate(SOILS))
)
_AVGS = ", ".join(f"avg({c}) AS {c}" for c in RAW)
_KEY = lambda k: f"(CASE WHEN {k} % 3 = 0 THEN 0 ELSE {k} % 997 + 1 END)"
_URL = lambda k: "[" + ", ".join(f"'{u}'" for u in URLS) + f"][({k} % {len(URLS)}) + 1]"
_CELL = lambda k: f"'BC-5K-' || lpad(({k})::VARCHAR, 7, '0')"
_ZONES = "[" + ", ".join(f"'{z}'" for z in K.ZONES) + "]"

# name -> (tables it needs, query)
CTES: dict[str, tuple[str, str]] = {
    "cells": ("", _placed_sql("customer", "c_custkey", "BC-5K-", 7919, 6007)),
    "stations": ("", _placed_sql("supplier", "s_suppkey", "WX-", 3571, 9343)),
    "fires": (
        "",
        "SELECT o_orderkey AS fire_id, 48.4::DOUBLE + (o_orderkey * 5381 % 11503) / 1000.0::DOUBLE AS lat,"
        " -138.9::DOUBLE + (o_orderkey * 7907 % 24709) / 1000.0::DOUBLE AS lon, o_orderdate::DATE AS date, year(o_orderdate) AS year,"
        " o_totalprice / 100.0::DOUBLE AS size_ha,"
        " CASE left(o_orderpriority, 1) WHEN '1' THEN 'lightning' WHEN '2' THEN 'lightning' WHEN '3' THEN 'human' WHEN '4' THEN 'human' ELSE 'unknown' END AS cause,"
        " CASE o_orderstatus WHEN 'F' THEN 'cnfdb' WHEN 'O' THEN 'bc_incidents' ELSE 'bc_perimeters' END AS source FROM orders",
    ),
    "steps": (
        "",
        "SELECT 'WX-' || lpad(l_suppkey::VARCHAR, 7, '0') AS cell_id, l_partkey, l_linenumber, l_shipdate AS ts, l_quantity - 10 AS q_t,"
        " round(l_discount * 100) * 8 + 15 AS q_h, (l_partkey * 7 % 60)::DOUBLE AS q_w, (l_partkey * 53 % 360)::DOUBLE AS q_d,"
        " (CASE WHEN l_linenumber <= 2 THEN l_orderkey % 25 ELSE 0 END)::DOUBLE AS q_r, round(l_tax * 100) AS q_e,"
        " (l_orderkey * 3 % 40 + 5)::DOUBLE AS q_s FROM lineitem",
    ),
    "weather": ("steps", f"SELECT cell_id, date, {_PHYS} FROM (SELECT cell_id, ts::DATE AS date, {_AVGS} FROM steps GROUP BY ALL)"),
    "node_weather": (
        "steps",
        f"SELECT wx_id, lead_day, {_PHYS} FROM (SELECT l_partkey % {N_NODES} AS wx_id, l_linenumber AS lead_day, {_AVGS} FROM steps GROUP BY ALL)",
    ),
    "history": (
        "",
        f"SELECT {_CELL('o_custkey')} AS cell_id, o_orderdate::DATE AS date, max(o_totalprice) / 500000.0::DOUBLE AS score FROM orders GROUP BY 1, 2",
    ),
    "predictions": ("history", "SELECT cell_id, max(date) AS date, arg_max(score, date) AS score FROM history GROUP BY 1"),
    "scored_cells": ("cells predictions", "SELECT c.*, p.score FROM cells c JOIN predictions p USING (cell_id)"),
    "labels_t": (
        "",
        "SELECT l_orderkey AS row_a, l_partkey AS row_b, l_linenumber AS row_c, l_shipdate::DATE AS date, year(l_shipdate) AS year, y,"
        " ((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 701 + y * (l_suppkey * 13 % 301)) / 1000.0::DOUBLE AS p,"
        " ((l_orderkey * 29 + l_partkey * 23 + l_linenumber * 11) % 801 + y * (l_suppkey * 19 % 201)) / 1000.0::DOUBLE AS q,"
        f" CASE WHEN l_partkey % 21 < 14 THEN {_ZONES}[(l_partkey % 21) + 1] ELSE 'IDF' END AS bec_zone"
        " FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM lineitem)",
    ),
    "raster": ("", "SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice AS value FROM part"),
    "ticks": (
        "",
        "SELECT 'WX-' || lpad(user_id::VARCHAR, 7, '0') AS cell_id, ts,"
        " CASE WHEN event_type = 'error' THEN -1000 ELSE floor(value / 50) END AS flashes FROM events",
    ),
    "hourly": (
        "",
        "SELECT 'WX-' || lpad(user_id::VARCHAR, 7, '0') AS cell_id, ts, (event_id * 7 % 400) / 10.0::DOUBLE + 270 AS temperature_k,"
        " (event_id * 11 % 80 + 20)::DOUBLE AS rh_pct, (event_id * 13 % 150) / 10.0::DOUBLE AS wind_ms, (event_id * 53 % 360)::DOUBLE AS wind_dir_deg,"
        " CASE WHEN event_type = 'view' THEN (event_id % 16) / 8.0::DOUBLE ELSE 0 END AS precip_mm FROM events",
    ),
    "alerts": (
        "",
        f"SELECT c_custkey AS alert_id, {_KEY('c_custkey')} AS api_key, {_CELL('c_custkey')} AS cell_id, (c_custkey * 13 % 100) / 100.0::DOUBLE AS threshold,"
        f" {_URL('c_custkey')} AS webhook_url, c_custkey % 5 <> 0 AS is_active, (c_custkey % 5)::INT AS consecutive_failures, NULL::VARCHAR AS disabled_reason,"
        " CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2001-07-29 00:00:00' + to_hours((c_custkey * 7 % 144)::INT) END AS last_triggered,"
        " TIMESTAMP '2001-01-01 00:00:00' + to_days((c_custkey % 240)::INT) AS created_at FROM customer",
    ),
    "requests": (
        "",
        f"SELECT o_orderkey AS request_id, {_KEY('o_custkey')} AS api_key, {_CELL('o_custkey')} AS cell_id,"
        f" (o_orderkey % 2) * 0.5::DOUBLE + (o_custkey * 13 % 100) / 200.0::DOUBLE AS threshold, {_URL('o_custkey')} AS webhook_url FROM orders",
    ),
    "locations": (
        "",
        "SELECT o_orderkey AS location_id, 48.0::DOUBLE + (o_orderkey * 4271 % 12300) / 1000.0::DOUBLE AS lat,"
        " -139.4::DOUBLE + (o_orderkey * 3307 % 25700) / 1000.0::DOUBLE AS lon FROM orders",
    ),
    "properties": (
        "",
        "SELECT c_custkey AS property_id, 48.2::DOUBLE + (c_custkey * 6173 % 11900) / 1000.0::DOUBLE AS lat,"
        " -139.1::DOUBLE + (c_custkey * 4421 % 25100) / 1000.0::DOUBLE AS lon,"
        " CASE WHEN c_custkey % 9 <> 0 THEN greatest(c_acctbal, 0) * 100 END AS value_cad FROM customer",
    ),
    "active_fires": (
        "",
        "SELECT s_suppkey AS fire_id, 48.4::DOUBLE + (s_suppkey * 8123 % 11503) / 1000.0::DOUBLE AS lat,"
        " -138.9::DOUBLE + (s_suppkey * 5077 % 24709) / 1000.0::DOUBLE AS lon, s_acctbal AS size_ha FROM supplier",
    ),
    "features_28": (
        "",
        "SELECT j - 1 AS j, names[j] AS feature FROM (SELECT [" + ", ".join(f"'{f}'" for f in K.FEATURES) + "] AS names, unnest(range(1, 29)) AS j)",
    ),
    "contribution_rows": (
        "scored_cells features_28",
        "SELECT c.*, feature, ((k * ((j + 3) * 97) + j * j * 31) % 2001 - 1000) / 1000.0::DOUBLE AS c,"
        " (k * ((j + 5) * 13) % 1000) / 10.0::DOUBLE AS v FROM scored_cells c CROSS JOIN features_28",
    ),
}


def cte(name: str, needs: str, query: str) -> None:
    CTES[name] = (needs, query)


def with_tables(body: str, uses: str, recursive: bool = False) -> str:
    """The query with the domain tables it uses, and theirs, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0].split():
            visit(need)
        if name not in order:
            order.append(name)

    for name in uses.split():
        visit(name)
    if not order:
        return body
    keyword = "WITH RECURSIVE " if recursive or any("_rolled" in n for n in order) else "WITH "
    return keyword + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " + body
