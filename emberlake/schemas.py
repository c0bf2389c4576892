"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from emberlake.constants import CODES, FEATURES


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _DATE, _TS, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.DateType(), T.TimestampType(), T.BooleanType()

CELL = _struct(
    cell_id=_S, lat=_D, lon=_D, x=_D, y=_D, bec_zone=_S, fuel_type=_S,
    elevation_m=_D, slope_deg=_D, aspect_deg=_D, hillshade=_D, distance_to_road_km=_D,
)
WEATHER = _struct(
    cell_id=_S, date=_DATE, temperature_c=_D, rh_pct=_D, wind_kmh=_D, wind_dir_deg=_D, precip_24h_mm=_D, evapotrans_mm=_D,
    soil_moisture_1=_D, soil_moisture_2=_D, soil_moisture_3=_D, soil_moisture_4=_D, source=_S,
)
FWI = _struct(cell_id=_S, date=_DATE, **{c: _D for c in CODES})
FWI_STATE = _struct(cell_id=_S, as_of=_DATE, ffmc=_D, dmc=_D, dc=_D)
FEATURE_ROW = _struct(cell_id=_S, date=_DATE, lat=_D, lon=_D, **{c: _D for c in FEATURES})
TRAINING_ROW = _struct(cell_id=_S, date=_DATE, fire=_I, **{c: _D for c in FEATURES})
FIRE = _struct(lat=_D, lon=_D, date=_DATE, size_ha=_D, cause=_S, source=_S)
FEATURE_COLLECTION = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("geometry", _struct(type=_S, coordinates=_S)),
                        T.StructField("properties", T.MapType(_S, _S)),
                    ]
                )
            ),
        )
    ]
)
FORECAST_PAYLOAD = T.StructType(
    [
        T.StructField("latitude", _D),
        T.StructField("longitude", _D),
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField(name, T.ArrayType(_D))
                    for name in (
                        "temperature_2m_max",
                        "relative_humidity_2m_min",
                        "wind_speed_10m_max",
                        "wind_direction_10m_dominant",
                        "precipitation_sum",
                        "et0_fao_evapotranspiration",
                    )
                ]
            ),
        ),
    ]
)
PAYLOAD_COLUMNS = {
    "temperature_2m_max": "temperature_c",
    "relative_humidity_2m_min": "rh_pct",
    "wind_speed_10m_max": "wind_kmh",
    "wind_direction_10m_dominant": "wind_dir_deg",
    "precipitation_sum": "precip_24h_mm",
    "et0_fao_evapotranspiration": "evapotrans_mm",
}
RUN_LOG = _struct(run_id=_S, job=_S, status=_S, started_at=_TS, finished_at=_TS, cells=T.LongType(), error=_S)
