"""Distances, projections, pixels and tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.constants import (
    BOUNDARY_LONLAT,
    EARTH_KM,
    KM_PER_DEG,
    LAT_MAX,
    LAT_MIN,
    LON_MAX,
    LON_MIN,
    RASTER_H,
    RASTER_LAT,
    RASTER_LON,
    RASTER_W,
    WEATHER_COLS,
    WEATHER_ROWS,
    WEATHER_STEP_DEG,
)

KM_PER_DEG_LON = KM_PER_DEG * math.cos(math.radians(54.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M21."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    s1, s2 = F.sin(dlat / 2.0), F.sin(dlon / 2.0)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.atan2(F.sqrt(a), F.sqrt(1.0 - a)) * (2.0 * EARTH_KM)


def sphere(lat: Column, lon: Column) -> list[Column]:
    """A place as three coordinates in km from the centre of the earth; straight distances rank like those on the ground."""
    y, x = F.radians(lat), F.radians(lon)
    return [F.cos(y) * F.cos(x) * EARTH_KM, F.cos(y) * F.sin(x) * EARTH_KM, F.sin(y) * EARTH_KM]


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees scaled to km at 54 degrees north."""
    dy, dx = (lat1 - lat2) * KM_PER_DEG, (lon1 - lon2) * KM_PER_DEG_LON
    return F.sqrt(dy * dy + dx * dx)


def lon_reach_deg(lat: Column, radius_km: Column) -> Column:
    """Half-width in degrees of longitude of a circle on the sphere, rounded up.

    Beyond a pole the circle holds every longitude.
    """
    arc = radius_km / EARTH_KM
    ratio = F.sin(arc) / F.cos(F.radians(lat))
    over_pole = F.abs(F.radians(lat)) + arc >= math.pi / 2
    return F.when(over_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)


def lat_reach_deg(radius_km: Column) -> Column:
    return F.degrees(radius_km / EARTH_KM) + 1e-9


def coverage_error(lat: Column, lon: Column) -> Column:
    """Null inside the covered area, else the reason."""
    return (
        F.when(lat.isNull() | lon.isNull(), F.lit("missing coordinate"))
        .when(~lat.between(LAT_MIN, LAT_MAX), F.lit("latitude outside coverage"))
        .when(~lon.between(LON_MIN, LON_MAX), F.lit("longitude outside coverage"))
    )


# --- tiles ------------------------------------------------------------------------------------


def tile_x(lon: Column, zoom: Column) -> Column:
    """M23 forward, fractional tile column."""
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    """M23 forward, fractional tile row."""
    merc = F.asinh(F.tan(F.radians(lat)))
    return (1.0 - merc / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)


def tile_west(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: Column) -> Column:
    """M23 inverse."""
    return F.degrees(F.atan(F.sinh((1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)) * math.pi)))


# --- pixels -----------------------------------------------------------------------------------------


def pixel_row(lat: Column, north: float, south: float, height: int) -> Column:
    """Row 0 is north; the index is clamped to the raster."""
    index = F.floor((north - lat) / ((north - south) / height))
    return F.least(F.greatest(index, F.lit(0)), F.lit(height - 1)).cast("bigint")


def pixel_col(lon: Column, west: float, east: float, width: int) -> Column:
    """Column 0 is west."""
    index = F.floor((lon - west) / ((east - west) / width))
    return F.least(F.greatest(index, F.lit(0)), F.lit(width - 1)).cast("bigint")


def raster_row(lat: Column) -> Column:
    return pixel_row(lat, RASTER_LAT[1], RASTER_LAT[0], RASTER_H)


def raster_col(lon: Column) -> Column:
    return pixel_col(lon, RASTER_LON[0], RASTER_LON[1], RASTER_W)


def weather_node(lat: Column, lon: Column) -> Column:
    """Id of the nearest node of the regular weather grid, by arithmetic."""
    row = F.round((lat - LAT_MIN) / WEATHER_STEP_DEG)
    col = F.round((lon - LON_MIN) / WEATHER_STEP_DEG)
    row = F.least(F.greatest(row, F.lit(0.0)), F.lit(WEATHER_ROWS - 1.0))
    col = F.least(F.greatest(col, F.lit(0.0)), F.lit(WEATHER_COLS - 1.0))
    return (row * WEATHER_COLS + col).cast("bigint")


# --- equal-area projection (Albers, GRS80; standard parallels 50 and 58.5) ----------------------------

_A, _F = 6378137.0, 1 / 298.257222101
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)
_LAT0, _LON0, _P1, _P2, _FE, _FN = (math.radians(45.0), math.radians(-126.0), math.radians(50.0), math.radians(58.5), 1e6, 0.0)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(_P2) - _q(_P1))
_C = _m(_P1) ** 2 + _N * _q(_P1)
_RHO0 = _A * math.sqrt(_C - _N * _q(_LAT0)) / _N


def albers_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres from degrees."""
    s = F.sin(F.radians(lat))
    q = (s / (1.0 - s * s * _E2) - F.log((1.0 - s * _E) / (1.0 + s * _E)) / (2 * _E)) * (1 - _E2)
    rho = F.sqrt(_C - q * _N) * (_A / _N)
    theta = (F.radians(lon) - _LON0) * _N
    return rho * F.sin(theta) + _FE, _RHO0 - rho * F.cos(theta) + _FN


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees from metres, by the authalic-latitude series."""
    dx, dy = x - _FE, _RHO0 - (y - _FN)
    rho = F.sqrt(dx * dx + dy * dy)
    theta = F.atan2(dx, dy)
    q = (_C - (rho * (_N / _A)) * (rho * (_N / _A))) / _N
    q_pole = _q(math.pi / 2)
    beta = F.asin(q / q_pole)
    e4, e6 = _E2**2, _E2**3
    phi = (
        beta
        + F.sin(beta * 2.0) * (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)
        + F.sin(beta * 4.0) * (23 * e4 / 360 + 251 * e6 / 3780)
        + F.sin(beta * 6.0) * (761 * e6 / 45360)
    )
    return F.degrees(phi), F.degrees(theta / _N + _LON0)


def albers_point(lat_deg: float, lon_deg: float) -> tuple[float, float]:
    """The projection of one constant point (boundary vertices, extents)."""
    q = _q(math.radians(lat_deg))
    rho = _A * math.sqrt(_C - _N * q) / _N
    theta = _N * (math.radians(lon_deg) - _LON0)
    return _FE + rho * math.sin(theta), _FN + _RHO0 - rho * math.cos(theta)


def boundary_xy() -> list[tuple[float, float]]:
    return [albers_point(lat, lon) for lon, lat in BOUNDARY_LONLAT]


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting over a fixed ring, unrolled into one expression.

    The ring is a constant of the job, so no join is needed and the test stays
    in generated code.
    """
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1
