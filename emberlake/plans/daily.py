"""Daily risk and forecast."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.constants import DAILY_FEATURE_DEFAULTS, FEATURES, TRAINING_FEATURE_DEFAULTS
from emberlake.functions import weather as wx
from emberlake.functions.fwi import apply_diurnal
from emberlake.functions.score import danger_level, heuristic_score
from emberlake.ml.fuse import calibrate_score, parameter_frame
from emberlake.operators.temporal import as_of, forecast_record, forecast_roll, one_day

SOILS = [f"soil_moisture_{i}" for i in range(1, 5)]
OBSERVED = ["temperature_c", "rh_pct", "wind_kmh", "wind_dir_deg", "precip_24h_mm", "evapotrans_mm", *SOILS]
STATIC = ["elevation_m", "slope_deg", "aspect_deg", "hillshade", "distance_to_road_km"]
STORED_PLACES = {
    "ffmc": 1, "dmc": 1, "dc": 1, "isi": 1, "bui": 1, "fwi": 1,
    "temperature_c": 1, "rh_pct": 1, "wind_kmh": 1, "precip_24h_mm": 1, "ndvi": 3,
}


def fill_features(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Every feature present and filled, in the fixed order after the other columns."""
    others = [c for c in df.columns if c not in FEATURES]
    filled = [
        (F.coalesce(F.col(c).cast("double"), F.lit(defaults[c])) if c in defaults else F.col(c).cast("double"))
        if c in df.columns
        else F.lit(defaults.get(c)).cast("double")
        for c in FEATURES
    ]
    return df.select(*others, *[v.alias(c) for v, c in zip(filled, FEATURES)])


def assemble_features(
    coded: DataFrame, cells: DataFrame, vegetation: DataFrame | None = None, lightning: DataFrame | None = None, training: bool = False
) -> DataFrame:
    """The 28 features of each (cell, date), all joins on the cell or (cell, date)."""
    have = [c for c in ("lat", "lon", "bec_zone", *STATIC) if c in cells.columns]
    rows = coded.join(cells.select("cell_id", *have), "cell_id")
    if vegetation is not None:
        keys = ["cell_id", "date"] if "date" in vegetation.columns else ["cell_id"]
        rows = rows.join(vegetation, keys, "left")
    if lightning is not None:
        rows = rows.join(lightning, ["cell_id", "date"], "left")
    rows = rows.withColumns({"doy_sin": wx.doy_sin(F.col("date")), "doy_cos": wx.doy_cos(F.col("date"))})
    return fill_features(rows, TRAINING_FEATURE_DEFAULTS if training else DAILY_FEATURE_DEFAULTS)


def score_features(features: DataFrame) -> DataFrame:
    """G03 without a model: the closed-form score."""
    return features.withColumn(
        "raw_score", heuristic_score(F.col("temperature_c"), F.col("soil_moisture_1"), F.col("wind_kmh"), F.col("fwi"))
    )


def daily_risk(
    cells: DataFrame,
    weather: DataFrame,
    state: DataFrame,
    date: str,
    vegetation: DataFrame | None = None,
    lightning: DataFrame | None = None,
    levels: DataFrame | None = None,
    calibration: Mapping[str, tuple] | None = None,
    hour: int | None = 14,
    max_age_days: int = 7,
) -> DataFrame:
    """Q01: one day's record of every cell.

    Weather is the newest within the tolerance, else defaults; codes step from the
    carried state; the diurnal step changes only what is scored and shown.
    """
    day = F.lit(date).cast("date")
    recent = weather.where(F.col("date").between(F.date_sub(day, max_age_days), day))
    wanted = cells.select("cell_id").withColumn("date", day)
    observed = as_of(wanted, recent, OBSERVED, max_age_days, defaults={k: v for k, v in DAILY_FEATURE_DEFAULTS.items() if k in OBSERVED})
    coded = one_day(observed, state)
    if hour is not None:
        coded = apply_diurnal(coded, hour)
    scored = score_features(assemble_features(coded, cells, vegetation, lightning))
    scored = scored.withColumn("score", F.col("raw_score"))
    if calibration is not None:
        scored = calibrate_score(scored, parameter_frame(scored.sparkSession, calibration))
    if levels is not None:
        haines = levels.select("cell_id", F.bround(wx.c_haines(F.col("t850"), F.col("t500"), F.col("td850")), 2).alias("c_haines"))
        scored = scored.join(haines, "cell_id", "left")
    return prediction_record(scored)


def prediction_record(scored: DataFrame) -> DataFrame:
    """Stored rounding; the level comes from the unrounded score."""
    extra = [c for c in ("bec_zone", "as_of", "c_haines") if c in scored.columns]
    return scored.select(
        "cell_id",
        F.col("date").alias("prediction_date"),
        *extra,
        F.bround("score", 4).alias("score"),
        danger_level(F.col("score")).alias("level"),
        *[F.bround(c, n).alias(c) for c, n in STORED_PLACES.items()],
        F.bround("soil_moisture_1", 4).alias("soil_moisture"),
        (F.col("snow_cover") > 0).alias("snow_cover"),
        F.col("lightning_24h"),
        F.col("lightning_72h"),
    )


def forecast(cells: DataFrame, node_weather: DataFrame, base_date: str, seed: DataFrame | None = None, max_days: int = 10) -> DataFrame:
    """Q02: coarse-grid forecast copied to each cell's nearest node (J03), then rolled forward.

    The recurrence depends on the cell only through its weather and its state, so
    without per-cell states it is rolled once per node and copied afterwards.
    """
    from emberlake.functions.geo import weather_node

    mapped = cells.select("cell_id", weather_node(F.col("lat"), F.col("lon")).alias("wx_id"))
    if seed is None:
        rolled = forecast_record(forecast_roll(node_weather, base_date, max_days=max_days, key="wx_id"), "wx_id")
        # the coarse grid is fixed: at most ``max_days`` rows for each of its nodes
        return mapped.join(F.broadcast(rolled), "wx_id").drop("wx_id")
    fanned = mapped.join(node_weather, "wx_id").drop("wx_id")
    return forecast_record(forecast_roll(fanned, base_date, seed=seed, max_days=max_days))
