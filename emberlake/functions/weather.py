"""Unit conversions and weather indices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.functions.base import clip


def kelvin_to_celsius(kelvin: Column) -> Column:
    """M01."""
    return kelvin - 273.15


def relative_humidity(temp_k: Column, dew_k: Column) -> Column:
    """Magnus formula, bounded to 0..100 percent."""
    t, d = temp_k - 273.15, dew_k - 273.15
    ratio = F.exp(17.625 * d / (243.04 + d)) / F.exp(17.625 * t / (243.04 + t))
    return clip(100.0 * ratio, 0.0, 100.0)


def wind_speed_kmh(u: Column, v: Column) -> Column:
    """M03."""
    return F.hypot(u, v) * 3.6


def wind_direction(u: Column, v: Column) -> Column:
    """Direction the wind comes from, 0..360."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def precip_mm(metres: Column) -> Column:
    """Metres to mm, never negative; absent is 0."""
    return F.greatest(F.coalesce(metres, F.lit(0.0)) * 1000.0, F.lit(0.0))


def evapotranspiration_mm(metres: Column) -> Column:
    """Absolute mm; absent is 3."""
    return F.coalesce(F.abs(metres) * 1000.0, F.lit(3.0))


def doy_sin(day: Column) -> Column:
    """M07 (sine)."""
    return F.sin(F.dayofyear(day) * (2.0 * math.pi) / 365.0)


def doy_cos(day: Column) -> Column:
    """M07 (cosine)."""
    return F.cos(F.dayofyear(day) * (2.0 * math.pi) / 365.0)


def c_haines(t850: Column, t500: Column, td850: Column) -> Column:
    """0..13, null when any level is missing."""
    stability = clip((t850 - t500 - 22.0) / 8.0, 0.0, 6.0)
    moisture = clip((t850 - td850 - 1.0) / 2.5, 0.0, 7.0)
    return clip(stability + moisture, 0.0, 13.0)


def flame_length_m(intensity: Column) -> Column:
    """0 where the fire has no head intensity."""
    return F.when(intensity > 0, 0.0775 * F.pow(intensity, F.lit(0.46))).otherwise(F.lit(0.0))


def fire_type(crown_fraction: Column) -> Column:
    """Surface, intermittent crown or active crown fire."""
    return (
        F.when(crown_fraction >= 0.9, F.lit("active_crown"))
        .when(crown_fraction > 0.1, F.lit("intermittent_crown"))
        .otherwise(F.lit("surface"))
    )


def julian_day(day: Column) -> Column:
    """Day of a 365-day year (29 February counts as 1 March's number)."""
    before = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
    return F.element_at(F.array(*[F.lit(v) for v in before]), F.month(day)) + F.dayofmonth(day)
