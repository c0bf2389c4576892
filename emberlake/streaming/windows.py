"""Windowed streams: lightning, daily extremes, usage, risk sessions.

Each is a keyed table of partial results that batches are merged into (``KeyedTable``), and a
projection of it. A window is in the result from its first row on, open ones too, and late rows still count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.streaming.store import KeyedTable


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a parquet table: one file, or a folder of part files; all in one batch unless ``files_per_trigger`` is given."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern that only the path itself matches: the source takes a single file in no other way
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _month(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy_MM")


def _both(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new)


def lightning_table(root: str, buckets: int = 16) -> KeyedTable:
    """Flashes per cell and hour; the windows of any length are sums of these."""

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell_id", "hour").agg(F.sum("flashes").alias("flashes"))

    def partial(ticks: DataFrame) -> DataFrame:
        return total(ticks.select("cell_id", F.date_trunc("hour", "ts").alias("hour"), F.greatest(F.col("flashes"), F.lit(0.0)).alias("flashes")))

    return KeyedTable(root, ["cell_id"], partial, lambda old, new: total(_both(old, new)), buckets, _month("hour"))


def lightning_windows(hourly: DataFrame, hours: int) -> DataFrame:
    """Flashes per cell over windows of ``hours``, moved by one hour; every window with a tick.

    A window is listed by its last tick, which holds the ticks of the ``hours`` up to its own, so only the
    hourly rows are shuffled, by cell, and the windows, up to ``hours`` times as many, are neither moved nor grouped.
    """
    ticks = hourly.where(F.col("hour").isNotNull()).select("cell_id", F.floor(F.unix_seconds("hour") / 3600).alias("_at"), "flashes")
    in_order = Window.partitionBy("cell_id").orderBy("_at")
    held = F.collect_list(F.struct("_at", "flashes")).over(in_order.rangeBetween(1 - hours, Window.currentRow))
    following = F.lead("_at").over(in_order)
    first, last = F.col("_at") - (hours - 1), F.least(F.col("_at"), following - hours)
    ends = ticks.select("cell_id", held.alias("_held"), first.alias("_first"), last.alias("_last")).where(F.col("_last") >= F.col("_first"))

    def since(tick: Column, i: Column) -> Column:
        # windows that begin after the tick before this one and not after this one hold the same ticks
        known = F.filter(F.slice("_held", i + 1, F.size("_held")), lambda t: t["flashes"].isNotNull())
        total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda total, t: total + t["flashes"]))
        after = F.when(i > 0, F.get("_held", i - 1)["_at"] + 1).otherwise(F.col("_first"))
        return F.struct(F.greatest("_first", after).alias("low"), F.least("_last", tick["_at"]).alias("high"), total.alias("flashes"))

    alike = ends.select("cell_id", F.inline(F.filter(F.transform("_held", since), lambda s: s["low"] <= s["high"])))
    starts = alike.select("cell_id", F.explode(F.sequence("low", "high")).alias("_start"), "flashes")
    begin, end = (F.timestamp_seconds((F.col("_start") + shift) * 3600) for shift in (0, hours))
    return starts.select("cell_id", begin.alias("window_start"), end.alias("window_end"), "flashes")


def extremes_table(root: str, buckets: int = 16) -> KeyedTable:
    """Per cell and day the hottest, driest and windiest (of equal winds the first) and the rain."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell_id", "date").agg(
            F.max("temperature_k").alias("temperature_k"), F.min("rh_pct").alias("rh_pct"), F.max("windiest").alias("windiest"), F.sum("precip_mm").alias("precip_mm")
        )

    def partial(hourly: DataFrame) -> DataFrame:
        windiest = F.struct("wind_ms", (-F.unix_micros("ts")).alias("first"), "wind_dir_deg").alias("windiest")
        return combine(hourly.select("cell_id", F.to_date("ts").alias("date"), "temperature_k", "rh_pct", windiest, "precip_mm"))

    return KeyedTable(root, ["cell_id"], partial, lambda old, new: combine(_both(old, new)), buckets, _month("date"))


def daily_extremes(table: DataFrame) -> DataFrame:
    """The daily form of hourly weather."""
    return table.select(
        "cell_id", "date", (F.col("temperature_k") - 273.15).alias("temperature_c"), "rh_pct", (F.col("windiest.wind_ms") * 3.6).alias("wind_kmh"),
        F.col("windiest.wind_dir_deg").alias("wind_dir_deg"), F.greatest("precip_mm", F.lit(0.0)).alias("precip_24h_mm"),
    )


def usage_table(root: str, buckets: int = 16) -> KeyedTable:
    """Requests per key and Pacific day, by local time, so daylight saving is right."""

    def partial(requests: DataFrame) -> DataFrame:
        local = F.to_date(F.from_utc_timestamp("ts", "America/Vancouver")).alias("day")
        return requests.groupBy("api_key", local).agg(F.count(F.lit(1)).alias("used"))

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return _both(old, new).groupBy("api_key", "day").agg(F.sum("used").alias("used"))

    return KeyedTable(root, ["api_key"], partial, merge, buckets, _month("day"))


def joined_sessions(parts: DataFrame, gap: str = "25 hours") -> DataFrame:
    """Parts of sessions (``cell_id, first, last, records, max_score``) less than ``gap`` apart become one."""
    in_order = Window.partitionBy("cell_id").orderBy("first", "last")
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") < reach + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    numbered = parts.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("cell_id", "_session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("records").alias("records"), F.max("max_score").alias("max_score")
    )
    return joined.drop("_session")


def sessions_table(root: str, gap: str = "25 hours", buckets: int = 16) -> KeyedTable:
    """Runs of high-risk records per cell with less than ``gap`` (an hour at least) between them.

    Records of one hour are one run in any case; they are combined before the shuffle, so a cell
    with very many records brings its hours only.
    """

    def partial(alerts: DataFrame) -> DataFrame:
        hours = alerts.groupBy("cell_id", F.date_trunc("hour", "ts").alias("_hour")).agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("records"), F.max("score").alias("max_score")
        )
        return joined_sessions(hours.drop("_hour"), gap)

    return KeyedTable(root, ["cell_id"], partial, lambda old, new: new if old is None else joined_sessions(old.unionByName(new), gap), buckets)


def risk_sessions(table: DataFrame, gap: str = "25 hours") -> DataFrame:
    """The sessions with their windows, which last until the gap is over."""
    return table.select("cell_id", F.col("first").alias("session_start"), (F.col("last") + F.expr(f"INTERVAL {gap}")).alias("session_end"), "records", "max_score")
