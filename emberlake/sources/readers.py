"""Scans (S01-S09, S17, S19-S21)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.constants import CAUSE_CODES, FEATURES
from emberlake.functions.base import lookup
from emberlake.schemas import CELL, FEATURE_COLLECTION, FIRE, FORECAST_PAYLOAD, PAYLOAD_COLUMNS

DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy", "yyyy"]
GRID_REQUIRED = ["cell_id", "lat", "lon", "bec_zone", "fuel_type"]


def read_grid(spark: SparkSession, path: str, required: Sequence[str] = GRID_REQUIRED) -> DataFrame:
    """The stored grid; an error when a required column is absent or it has no rows."""
    found = spark.read.parquet(path)
    missing = sorted(set(required) - set(found.columns))
    if missing:
        raise ValueError(f"grid lacks columns {missing}")
    if found.isEmpty():
        raise ValueError("grid is empty")
    known = [f for f in CELL if f.name in found.columns]
    return found.select(*[F.col(f.name).cast(f.dataType) for f in known])


def first_available(readers: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that answers; the last error if none does."""
    error: Exception | None = None
    for reader in readers:
        try:
            return reader()
        except Exception as exc:  # any unreadable source falls through to the next
            error = exc
    raise ValueError("no source available") from error


def parse_date(text: Column) -> Column:
    """Lenient date: the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def _column(columns: Sequence[str], *parts: str) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def read_fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns found by name parts; missing size is 0; no cause in this form."""
    raw = spark.read.csv(path, header=True)
    lat, lon = _column(raw.columns, "lat"), _column(raw.columns, "lon")
    day, size = _column(raw.columns, "date"), _column(raw.columns, "size", "area")
    if lat is None or lon is None:
        return spark.createDataFrame([], FIRE)
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(
        number(lat).alias("lat"),
        number(lon).alias("lon"),
        (parse_date(F.col(day)) if day else F.lit(None).cast("date")).alias("date"),
        (F.coalesce(number(size), F.lit(0.0)) if size else F.lit(0.0)).alias("size_ha"),
        F.lit(None).cast("string").alias("cause"),
        F.lit("cnfdb").alias("source"),
    )


def read_features(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """GeoJSON features as (type, coordinates text, properties map).

    One feature collection per file is read whole by one task; collections that
    are cut into one per line (``per_line``) split like any text file.
    """
    raw = spark.read.schema(FEATURE_COLLECTION).json(path, multiLine=not per_line)
    f = F.col("f")
    return raw.select(F.explode("features").alias("f")).select(
        f["geometry"]["type"].alias("type"), f["geometry"]["coordinates"].alias("coordinates"), f["properties"].alias("properties")
    )


def _prop(*names: str) -> Column:
    """First property that is present and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at("properties", F.lit(n)), F.lit("")) for n in names])


def _point() -> tuple[Column, Column]:
    xy = F.from_json("coordinates", T.ArrayType(T.DoubleType()))
    is_point = F.col("type") == "Point"
    return F.when(is_point, F.try_element_at(xy, F.lit(2))), F.when(is_point, F.try_element_at(xy, F.lit(1)))


def cause_from_text(text: Column) -> Column:
    """Cause by words or code."""
    low = F.lower(text)
    return (
        F.when(low.contains("lightning") | (text == "N"), "lightning")
        .when(low.contains("human") | low.contains("person") | (text == "H"), "human")
        .otherwise("unknown")
    )


def cnfdb_features(features: DataFrame) -> DataFrame:
    """Fire points with coded causes."""
    lat, lon = _point()
    return features.select(
        F.coalesce(lat, _prop("LATITUDE", "LAT").try_cast("double")).alias("lat"),
        F.coalesce(lon, _prop("LONGITUDE", "LON").try_cast("double")).alias("lon"),
        parse_date(_prop("REP_DATE", "DATE")).alias("date"),
        F.coalesce(_prop("SIZE_HA", "AREA_HA").try_cast("double"), F.lit(0.0)).alias("size_ha"),
        lookup(CAUSE_CODES, F.coalesce(_prop("CAUSE"), F.lit("U")), "unknown").alias("cause"),
        F.lit("cnfdb").alias("source"),
    )


def incident_features(features: DataFrame) -> DataFrame:
    """Incidents with the first of several date and size columns."""
    lat, lon = _point()
    return features.where(F.col("type").isNotNull()).select(
        lat.alias("lat"),
        lon.alias("lon"),
        parse_date(_prop("IGNITION_DATE", "FIRE_DATE", "IGN_DATE", "START_DATE")).alias("date"),
        F.coalesce(_prop("CURRENT_SIZE", "SIZE_HA", "FIRE_SIZE").try_cast("double"), F.lit(0.0)).alias("size_ha"),
        cause_from_text(F.coalesce(_prop("FIRE_CAUSE", "CAUSE"), F.lit(""))).alias("cause"),
        F.lit("bc_incidents").alias("source"),
    )


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring of [x, y] (shoelace); vertex mean if it has no area."""
    a = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    b = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    # offsets from the first vertex keep the products small
    x0, y0 = ring[0][0], ring[0][1]
    terms = F.transform(
        F.arrays_zip(a.alias("a"), b.alias("b")),
        lambda e: F.struct(
            (e["a"][0] - x0).alias("x"),
            (e["a"][1] - y0).alias("y"),
            (e["b"][0] - x0).alias("u"),
            (e["b"][1] - y0).alias("v"),
        ),
    )
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def add(acc: Column, t: Column) -> Column:
        cross = t["x"] * t["v"] - t["u"] * t["y"]
        return F.struct(
            (acc["s"] + cross).alias("s"),
            (acc["cx"] + (t["x"] + t["u"]) * cross).alias("cx"),
            (acc["cy"] + (t["y"] + t["v"]) * cross).alias("cy"),
        )

    total = F.aggregate(terms, start, add)
    flat = F.aggregate(
        a, F.array(F.lit(0.0), F.lit(0.0)), lambda acc, p: F.array(acc[0] + p[0], acc[1] + p[1])
    )
    n = F.nullif(F.size(a).cast("double"), F.lit(0.0))
    three = F.nullif(total["s"] * 3.0, F.lit(0.0))
    return F.struct(
        F.coalesce(x0 + total["cx"] / three, flat[0] / n).alias("x"), F.coalesce(y0 + total["cy"] / three, flat[1] / n).alias("y")
    )


def perimeter_features(features: DataFrame) -> DataFrame:
    """Outer-ring centroids; a bare year becomes 1 January."""
    rings = F.from_json("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
    located = features.where(F.col("type") == "Polygon").withColumn("_c", ring_centroid(rings[0]))
    return located.select(
        F.col("_c.y").alias("lat"),
        F.col("_c.x").alias("lon"),
        parse_date(_prop("FIRE_DATE", "IGN_DATE", "IGNITION_DATE", "FIRE_YEAR")).alias("date"),
        F.coalesce(_prop("FIRE_SIZE_HECTARES", "SIZE_HA", "FIRE_SIZE_HA", "CURRENT_SIZE").try_cast("double"), F.lit(0.0)).alias("size_ha"),
        cause_from_text(F.coalesce(_prop("FIRE_CAUSE", "CAUSE"), F.lit(""))).alias("cause"),
        F.lit("bc_perimeters").alias("source"),
    )


def fire_history(sources: Sequence[DataFrame], dedupe: bool = False) -> DataFrame:
    """All sources together, rows without place or date dropped.

    Sources overlap; ``dedupe`` keeps the first of each (date, lat, lon).
    """
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    whole = joined.dropna(subset=["lat", "lon", "date"])
    if not dedupe:
        return whole
    rest = [c for c in whole.columns if c not in ("lat", "lon", "date")]
    first = whole.groupBy("date", "lat", "lon").agg(F.min_by(F.struct(*rest), F.struct("source", "size_ha")).alias("_f"))
    return first.select("date", "lat", "lon", "_f.*")


def date_pool(spark: SparkSession, path: str) -> DataFrame:
    """Distinct dates of a feature table; only that column is read."""
    return spark.read.parquet(path).select("date").distinct()


def model_input(df: DataFrame, label: str = "fire") -> DataFrame:
    """Available features, missing to 0, infinite to +-1e6."""
    names = [c for c in FEATURES if c in df.columns]

    def clean(c: str) -> Column:
        v = F.col(c).cast("double")
        kept = F.when(F.isnan(v) | v.isNull(), F.lit(0.0)).otherwise(v)
        return F.least(F.greatest(kept, F.lit(-1e6)), F.lit(1e6)).alias(c)

    others = [c for c in df.columns if c not in names and c != label]
    return df.select(*others, F.col(label), *[clean(c) for c in names])


def forecast_payload(raw: DataFrame, text: str = "payload") -> DataFrame:
    """One JSON document per place to one row per lead day; nulls stay missing."""
    parsed = raw.withColumn("_p", F.from_json(text, FORECAST_PAYLOAD))
    none = F.array().cast("array<double>")
    # an absent variable is as long as the others, all missing
    arrays = [F.coalesce(F.col(f"_p.daily.{src}"), none).alias(dst) for src, dst in PAYLOAD_COLUMNS.items()]
    exploded = parsed.select(*[c for c in raw.columns if c != text], F.posexplode(F.arrays_zip(*arrays)).alias("lead_day", "_d"))
    return exploded.select("*", "_d.*").drop("_d")


def road_vertices(features: DataFrame) -> DataFrame:
    """Vertices of LineString and MultiLineString geometries."""
    line = F.from_json("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))
    lines = F.from_json("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
    points = F.when(F.col("type") == "LineString", line).when(F.col("type") == "MultiLineString", F.flatten(lines))
    vertex = features.select(F.explode(points).alias("v")).select(F.col("v")[1].alias("lat"), F.col("v")[0].alias("lon"))
    return vertex.withColumn("vertex_id", F.xxhash64("lat", "lon"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """A zone parameter document {zone: {xgb_weight, cnn_weight, bias}} as rows."""
    kind = T.MapType(
        T.StringType(), T.StructType([T.StructField(n, T.DoubleType()) for n in ("xgb_weight", "cnn_weight", "bias")])
    )
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("bec_zone", "p")).select("bec_zone", "p.*")


def add_missing_variables(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a supplementary variable table, taking only what the base lacks."""
    new = [c for c in extra.columns if c not in base.columns]
    return base.join(extra.select(*keys, *new), list(keys), "left")
