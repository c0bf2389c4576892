"""Levels, scores, labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.constants import (
    CONFIDENCE_DECAY,
    DIRECTION_PHRASE,
    DRIVER_TEXT,
    LEVEL_COLORS,
    LEVEL_CUTS,
    LEVEL_PREAMBLE,
    LEVEL_RGB,
    LEVELS,
    NO_DRIVERS_TEXT,
    PREAMBLE_DEFAULT,
    SEASON_MONTHS_DEFAULT,
    SEASON_SPAN,
    SEASON_SPAN_DEFAULT,
    SEASONAL_CURVES,
    SEASONAL_DEFAULT,
    SEVERITY_FACTORS,
    ZONE_FUEL,
    ZONE_NAMES,
    ZONE_SEASON_MONTHS,
)
from emberlake.functions.base import clip, lookup, steps


def danger_level(score: Column) -> Column:
    """P01 (on the unrounded score)."""
    return steps(score, LEVEL_CUTS, LEVELS)


def danger_ordinal(level: Column) -> Column:
    """1..6."""
    return F.array_position(F.array(*[F.lit(v) for v in LEVELS]), level)


def danger_color(level: Column) -> Column:
    """P03."""
    return lookup(LEVEL_COLORS, level)


def zone_of(lat: Column, lon: Column, elevation: Column) -> Column:
    """First matching rule; null or sentinel elevation counts as 0."""
    z = F.when(elevation > -9999, elevation).otherwise(F.lit(0.0))
    return (
        F.when(lat > 57, "BWBS")
        .when((lat > 55) & (z > 1200), "SWB")
        .when(lat > 55, "BWBS")
        .when(z > 1800, "AT")
        .when(z > 1400, "ESSF")
        .when((z > 1000) & (lon < -124), "MH")
        .when(z > 1000, "MS")
        .when((lat < 49.5) & (lon > -120) & (z < 600), "PP")
        .when((lat < 49.5) & (lon > -120), "IDF")
        .when((lon < -125) & (z < 800), "CWH")
        .when(lon < -125, "MH")
        .when((lon < -122) & (lat < 49.5), "CDF")
        .when(lon < -122, "ICH")
        .when(lat > 52, "SBS")
        .when(z < 1200, "IDF")
        .otherwise("ESSF")
    )


def fuel_of(zone: Column) -> Column:
    """P10."""
    return lookup(ZONE_FUEL, zone, "C3")


def zone_name(zone: Column) -> Column:
    """P11."""
    return F.coalesce(lookup(ZONE_NAMES, zone), zone)


def seasonal_index(zone: Column, month: Column) -> Column:
    """Monthly index of the zone's curve."""
    curves = F.create_map(
        *[c for z, v in SEASONAL_CURVES.items() for c in (F.lit(z), F.array(*[F.lit(x) for x in v]))]
    )
    default = F.array(*[F.lit(x) for x in SEASONAL_DEFAULT])
    return F.element_at(F.coalesce(F.element_at(curves, zone), default), month.cast("int"))


def season_span(zone: Column) -> Column:
    return lookup({z: v[0] for z, v in SEASON_SPAN.items()}, zone, SEASON_SPAN_DEFAULT[0])


def season_peak(zone: Column) -> Column:
    return lookup({z: v[1] for z, v in SEASON_SPAN.items()}, zone, SEASON_SPAN_DEFAULT[1])


def anomaly_status(pct: Column) -> Column:
    """P17."""
    names = ["WELL_BELOW_NORMAL", "BELOW_NORMAL", "NEAR_NORMAL", "ABOVE_NORMAL", "WELL_ABOVE_NORMAL", "RECORD_HIGH"]
    return steps(pct, [-20, 0, 50, 150, 300], names)


def percentile_label(pct: Column) -> Column:
    """P18."""
    names = ["WELL_BELOW_AVERAGE", "BELOW_AVERAGE", "AVERAGE", "ABOVE_AVERAGE", "WELL_ABOVE_AVERAGE"]
    return steps(pct, [20, 40, 60, 80], names)


def logit(p: Column, eps: float = 1e-7) -> Column:
    """M20."""
    bounded = clip(p, eps, 1 - eps)
    return F.log(bounded / (1.0 - bounded))


def sigmoid(x: Column) -> Column:
    """M20."""
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def heuristic_score(temp: Column, soil: Column, wind: Column, fwi: Column, noise: Column | None = None) -> Column:
    """M27, daily form. ``noise`` is off unless given."""
    base = (
        0.3 * clip((temp - 10.0) / 30.0, 0.0, 1.0)
        + 0.3 * clip(1.0 - soil / 0.5, 0.0, 1.0)
        + 0.15 * clip(wind / 40.0, 0.0, 1.0)
        + 0.25 * clip(fwi / 40.0, 0.0, 1.0)
    )
    return clip(base if noise is None else base + noise, 0.0, 1.0)


def heuristic_forecast_score(temp: Column, fwi: Column) -> Column:
    """M27, forecast form."""
    return clip(0.5 * clip((temp - 10.0) / 30.0, 0.0, 1.0) + 0.5 * clip(fwi / 40.0, 0.0, 1.0), 0.0, 1.0)


def composite(susceptibility_pct: Column, exposure_pct: Column, score: Column) -> Column:
    """M28."""
    return clip(0.3 * susceptibility_pct / 100.0 + 0.3 * exposure_pct / 100.0 + 0.4 * score, 0.0, 1.0)


def departure_pct(current: Column, base: Column) -> Column:
    """M29."""
    return (
        F.when(base > 0, (current - base) / F.nullif(base, F.lit(0.0)) * 100.0)
        .when(current > 0, current * 10000.0)
        .otherwise(F.lit(0.0))
    )


def annual_loss(value: Column, composite_score: Column, severity: Column, zone: Column) -> Column:
    """Null unless a positive value is insured."""
    factor = lookup(SEVERITY_FACTORS, severity, SEVERITY_FACTORS["low"])
    months = lookup(ZONE_SEASON_MONTHS, zone, SEASON_MONTHS_DEFAULT)
    return F.when(value > 0, F.round(value * composite_score * factor * (months / 12.0), 2))


def confidence(lead_day: Column) -> Column:
    """M31."""
    return F.pow(F.lit(CONFIDENCE_DECAY), lead_day)


def interval(lower: Column, upper: Column) -> Column:
    """Bounds in [0, 1], in order, with their level."""
    lo, hi = clip(lower, 0.0, 1.0), clip(upper, 0.0, 1.0)
    return F.struct(
        F.bround(F.least(lo, hi), 4).alias("lower"),
        F.bround(F.greatest(lo, hi), 4).alias("upper"),
        F.lit(0.90).alias("level"),
    )


def rgba(score: Column, edge: str = "below", colormap: str = "risk") -> Column:
    """``edge='below'`` starts a colour at its cut (tiles), ``'above'`` beyond it (heatmap)."""
    if colormap == "grayscale":
        gray = F.floor(score * 255.0).cast("int")
        return F.struct(gray.alias("r"), gray.alias("g"), gray.alias("b"), F.lit(255).alias("a"))
    band = F.lit(0)
    for cut in LEVEL_CUTS:
        passed = score > cut if edge == "above" else score >= cut
        band = band + F.when(passed, 1).otherwise(0)
    parts = [
        F.element_at(F.array(*[F.lit(rgb[i]) for rgb in LEVEL_RGB]), (band + 1).cast("int")).alias(name)
        for i, name in enumerate("rgb")
    ]
    alpha = F.least(F.lit(255), F.floor(score * 205.0 + 50.0).cast("int")).alias("a")
    return F.struct(*parts, alpha)


# --- explanations ---------------------------------------------------------------------------------------


def driver_description(feature: Column, value: Column) -> Column:
    """The sentence of one feature with its value."""
    branches = F.when(F.lit(False), F.lit(""))
    for name, (before, decimals, after) in DRIVER_TEXT.items():
        if decimals is None:
            text = F.lit(before)
        else:
            text = F.concat(F.lit(before), F.format_string(f"%.{decimals}f", F.bround(value, decimals)), F.lit(after))
        branches = branches.when(feature == name, text)
    return branches.otherwise(F.concat(feature, F.lit(" = "), F.format_string("%.4f", F.bround(value, 4))))


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, F.lit("increasing")).otherwise(F.lit("decreasing"))


def summary_text(drivers: Column, level: Column) -> Column:
    """The level, its three strongest drivers with their effect, and the names of the weaker ones in brackets.

    ``drivers`` is an array of struct(feature, direction, description).
    """
    opening = lookup(LEVEL_PREAMBLE, F.upper(level), PREAMBLE_DEFAULT)
    strong = F.transform(F.slice(drivers, 1, 3), lambda d: F.concat(d["description"], F.lit(" "), lookup(DIRECTION_PHRASE, d["direction"])))
    weak = F.array_join(F.transform(F.slice(drivers, 4, 28), lambda d: F.replace(d["feature"], F.lit("_"), F.lit(" "))), ", ")
    closing = F.when(F.size(drivers) > 3, F.concat(F.lit(" (less: "), weak, F.lit(")"))).otherwise(F.lit(""))
    empty = drivers.isNull() | (F.size(drivers) == 0)
    return F.concat(opening, F.when(empty, F.lit(NO_DRIVERS_TEXT)).otherwise(F.concat(F.lit(" "), F.array_join(strong, "; "), closing)))
