"""Answers over cells and locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.constants import LEVELS
from emberlake.functions.geo import coverage_error
from emberlake.functions.score import (
    annual_loss,
    composite,
    danger_color,
    danger_level,
    direction,
    driver_description,
    season_peak,
    season_span,
    zone_name,
)
from emberlake.operators.skew import dealt
from emberlake.operators.spatial import nearest


def latest(history: DataFrame, values: Sequence[str], key: str = "cell_id", run: str = "run_ts", since: Column | None = None) -> DataFrame:
    """Newest record per key, none older than ``since``; a combiner, no sort."""
    fresh = history if since is None else history.where(F.col(run) > since)
    return fresh.groupBy(key).agg(F.max_by(F.struct(F.col(run), *values), run).alias("_l")).select(key, "_l.*")


def parse_bbox(bbox: str) -> tuple[float, float, float, float]:
    parts = [float(p) for p in bbox.split(",")]
    if len(parts) != 4:
        raise ValueError("bbox must be south,west,north,east")
    return tuple(parts)


def risk_grid(cells: DataFrame, bbox: str, level: str | None = None) -> DataFrame:
    """Cells of a box, optionally of one level, one GeoJSON feature per row."""
    south, west, north, east = parse_bbox(bbox)
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    picked = cells.where(inside).withColumn("level", danger_level(F.col("score")))
    if level is not None:
        picked = picked.where(F.col("level") == level.upper())
    return picked.withColumn("color", danger_color(F.col("level")))


def as_features(cells: DataFrame, properties: Sequence[str]) -> DataFrame:
    """The feature text of each cell; one row each, so an area of any size can be written out."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return cells.select("cell_id", F.to_json(feature).alias("feature"))


def zone_summary(cells: DataFrame) -> DataFrame:
    """Mean, maximum, level of the unrounded mean, cells and high-risk cells per zone."""
    out = cells.groupBy("bec_zone").agg(
        F.avg("score").alias("_mean"),
        F.round(F.max("score"), 3).alias("max_score"),
        F.count(F.lit(1)).alias("cell_count"),
        F.count_if(F.col("score") >= 0.60).alias("high_risk_cells"),
    )
    return out.select(
        "bec_zone",
        zone_name(F.col("bec_zone")).alias("zone_name"),
        F.round("_mean", 3).alias("avg_score"),
        "max_score",
        danger_level(F.col("_mean")).alias("level"),
        "cell_count",
        "high_risk_cells",
    ).orderBy("bec_zone")


def zone_drivers(cells: DataFrame, top_n: int = 5) -> DataFrame:
    """Features by mean absolute contribution per zone, best ``top_n``; zones without any stay."""
    zone = F.coalesce(F.nullif("bec_zone", F.lit("")), F.lit("UNKNOWN")).alias("bec_zone")
    counted = cells.groupBy(zone).agg(F.count(F.lit(1)).alias("cell_count"))
    means = (
        cells.select(zone, F.explode("contributions").alias("feature", "c"))
        .groupBy("bec_zone", "feature")
        .agg(F.avg(F.abs("c")).alias("mean_abs"))
    )
    best = Window.partitionBy("bec_zone").orderBy(F.desc("mean_abs"), "feature")
    ranked = means.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
    return counted.join(F.broadcast(ranked), "bec_zone", "left").orderBy("bec_zone", "rank")


def feature_importance(cells: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        cells.select(F.explode("contributions").alias("feature", "c"))
        .groupBy("feature")
        .agg(F.avg(F.abs("c")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def top_drivers(contributions: Column, values: Column, n: int = 5) -> Column:
    """The ``n`` largest contributions by size with value, direction and text."""
    ordered = F.array_sort(
        F.transform(F.map_entries(contributions), lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("f"), e["value"].alias("c")))
    )

    def describe(d: Column) -> Column:
        value = F.coalesce(F.element_at(values, d["f"]), F.lit(0.0))
        return F.struct(
            d["f"].alias("feature"),
            F.bround(d["c"], 6).alias("contribution"),
            value.alias("value"),
            direction(d["c"]).alias("direction"),
            driver_description(d["f"], value).alias("description"),
        )

    return F.transform(F.slice(ordered, 1, n), describe)


def locate(locations: DataFrame, cells: DataFrame, location_id: str) -> DataFrame:
    """J14 entry: each location with its nearest cell, or the reason it has none."""
    checked = locations.withColumn("error", coverage_error(F.col("lat"), F.col("lon")))
    good = checked.where(F.col("error").isNull()).select(location_id, "lat", "lon")
    found = nearest(good, cells.select("cell_id", "lat", "lon"), location_id, "cell_id").select(location_id, "cell_id")
    return checked.join(dealt(found), location_id, "left")


def star_lookup(located: DataFrame, cells: DataFrame, predictions: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Cell attributes, prediction and statistics of located rows; a missing prediction is an error row."""
    attributes = cells.select("cell_id", "bec_zone", "fuel_type", "elevation_m")
    joined = located.join(dealt(attributes), "cell_id", "left").join(dealt(predictions), "cell_id", "left")
    if stats is not None:
        joined = joined.join(dealt(stats.drop("lat", "lon", "bec_zone", "fuel_type")), "cell_id", "left")
    missing = F.when(F.col("cell_id").isNotNull() & F.col("score").isNull(), F.lit("No prediction data available"))
    return joined.withColumn("error", F.coalesce("error", missing))


def forecast_maximum(forecast: DataFrame, days: int = 3) -> DataFrame:
    """Highest risk of the first days; 0 becomes null."""
    return forecast.groupBy("cell_id").agg(
        F.nullif(F.max(F.when(F.col("lead_day") <= days, F.col("risk_score"))), F.lit(0.0)).alias("forecast_3day_max")
    )


def portfolio(properties: DataFrame, cells: DataFrame, predictions: DataFrame, stats: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Q05: the assessment row of every property (id, lat, lon, value_cad)."""
    rows = star_lookup(locate(properties, cells, "property_id"), cells, predictions, stats)
    if forecast is not None:
        rows = rows.join(dealt(forecast_maximum(forecast)), "cell_id", "left")
    ok = F.col("error").isNull()
    susc = F.coalesce("susceptibility_percentile", F.lit(0))
    exposure = F.coalesce("exposure_percentile", F.lit(0))
    rows = rows.withColumn("composite_score", F.when(ok, composite(susc, exposure, F.col("score"))))
    return rows.withColumns(
        {
            "current_level": F.when(ok, danger_level(F.col("score"))),
            "composite_level": F.when(ok, danger_level(F.col("composite_score"))),
            "zone_name": F.when(ok, zone_name(F.col("bec_zone"))),
            "fire_season": F.when(ok, season_span(F.col("bec_zone"))),
            "peak_month": F.when(ok, season_peak(F.col("bec_zone"))),
            "estimated_annual_loss_cad": F.when(
                ok, annual_loss(F.col("value_cad"), F.col("composite_score"), F.coalesce("typical_severity", F.lit("low")), F.col("bec_zone"))
            ),
        }
    )


def portfolio_summary(assessed: DataFrame) -> DataFrame:
    """Totals of the whole portfolio, each zone and each level in one pass.

    ``bec_zone`` and ``composite_level`` are null in the rows that sum over them.
    """
    ok = assessed.where(F.col("error").isNull())
    value = F.coalesce("value_cad", F.lit(0.0))
    return ok.groupingSets(
        [[], ["bec_zone"], ["composite_level"], ["bec_zone", "composite_level"]], "bec_zone", "composite_level"
    ).agg(
        F.grouping_id().alias("level_of_total"),
        F.count(F.lit(1)).alias("properties"),
        F.avg("composite_score").alias("mean_composite"),
        F.max("composite_score").alias("max_composite"),
        F.sum(value).alias("insured_value"),
        F.sum(F.coalesce("estimated_annual_loss_cad", F.lit(0.0))).alias("annual_loss"),
    )


def level_distribution(assessed: DataFrame) -> DataFrame:
    """Properties and positive value per level, all six levels present."""
    spark = assessed.sparkSession
    frame = spark.createDataFrame([(i, name) for i, name in enumerate(LEVELS, 1)], "ordinal int, composite_level string")
    got = (
        assessed.where(F.col("error").isNull())
        .groupBy("composite_level")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("value_cad") > 0, F.col("value_cad"))).alias("value_at_risk"))
    )
    return frame.join(F.broadcast(got), "composite_level", "left").select(
        "ordinal", "composite_level", F.coalesce("_n", F.lit(0)).alias("properties"), "value_at_risk"
    )


def history_slice(history: DataFrame, until: Column, days: int) -> DataFrame:
    """Records of the last ``days`` days (1..90) up to a day, ordered by date."""
    if not 1 <= days <= 90:
        raise ValueError("days must be in 1..90")
    return history.where(F.col("date").between(F.date_sub(until, days), until))
