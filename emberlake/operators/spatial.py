"""Spatial joins as equi-joins on bins plus an exact residual."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.constants import BUFFER_DAYS, FIRE_CELL_CAP_DEG, FIRE_RADIUS_KM, KM_PER_DEG
from emberlake.functions.geo import KM_PER_DEG_LON, haversine_km, lat_reach_deg, lon_reach_deg
from emberlake.operators.neighbours import k_nearest
from emberlake.operators.skew import dealt, salted_join


def _bin(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("bigint")


#: Targets that a bin may hold when targets are spread out evenly enough for bins of one size.
FULLEST = 64


def nearest(
    points: DataFrame,
    targets: DataFrame,
    point_id: str,
    target_id: str,
    scale: tuple[float, float] = (1.0, 1.0),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exact nearest target of every point: J01, J02, J04, J21.

    Distance is Euclidean in (lat * scale[0], lon * scale[1]); equal distances go
    to the smallest target id. Adds ``<target_id>`` and ``distance`` to the points'
    columns; points without coordinates are dropped. ``keep`` names further target
    columns to bring along.

    Two plans give the same rows. Where the targets are spread out over the whole area of points
    and targets, so that no bin of their mean spacing holds many, all bins have that size
    (``_by_even_bins``); where they cluster, bins are split only where they are full
    (``k_nearest``). Two small jobs tell which is the case.
    """
    sy, sx = scale
    places = (
        targets.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy((F.col("lat") * sy).alias("_ty"), (F.col("lon") * sx).alias("_tx"))
        .agg(F.min(F.struct(target_id, *keep)).alias("_t"))
    )
    asked = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("lat") * sy, F.col("lon") * sx, F.lit(0))
    everything = places.select("_ty", "_tx", F.lit(1).alias("_n")).union(asked)
    n, y0, y1, x0, x1 = everything.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.min("_ty"), F.max("_ty"), F.min("_tx"), F.max("_tx")).first()
    size = max(math.sqrt(max(y1 - y0, 1e-6) * max(x1 - x0, 1e-6) / n), 1e-4) if n else 1.0
    per_bin = places.groupBy(_bin(F.col("_ty"), size), _bin(F.col("_tx"), size)).count()
    if n <= FULLEST or per_bin.agg(F.max("count")).first()[0] <= FULLEST:
        return _by_even_bins(points, places, size, scale, point_id, target_id, keep)
    at = [F.col("lat") * sy, F.col("lon") * sx]
    found = k_nearest(points, targets, at, at, target_id, keep=keep)
    best = F.col("_near")[0]
    return found.select(*points.columns, *[best["t"][c].alias(c) for c in (target_id, *keep)], F.sqrt(best["d2"]).alias("distance"))


def _by_even_bins(
    points: DataFrame, places: DataFrame, size: float, scale: tuple[float, float], point_id: str, target_id: str, keep: Sequence[str]
) -> DataFrame:
    """The nearest of ``places`` (``_ty``, ``_tx``, ``_t``), of which no bin of ``size`` holds many.

    The search is planned per *bin of points*, not per point. Bins double in size
    from level to level up to one that holds everything. The lowest level at which
    the bin around a base bin holds a target bounds the distance by that bin's
    diagonal, so the 3 x 3 block one level up must contain the nearest target of
    every point of the base bin. Of the occupied base bins in that block only those
    that can win for some point stay, then only such targets. What is left is a
    short list per bin, because no base bin holds many targets. Points meet the
    list of their bin in one join, salted where one bin has many points, and take
    the least distance in place: they are shuffled once and never grouped.
    """
    sy, sx = scale
    top = max(2, math.ceil(math.log2(360.0 * max(sy, sx) / size)) + 1)
    side = lambda y, x: [_bin(F.col(y), size).alias("_by"), _bin(F.col(x), size).alias("_bx")]
    ladder = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_k")
    up = lambda c: F.when(F.col("_k") < top, F.call_function("shiftright", F.col(c), F.col("_k"))).otherwise(F.lit(0))

    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "*", (F.col("lat") * sy).alias("_py"), (F.col("lon") * sx).alias("_px")
    )
    placed = placed.select("*", *side("_py", "_px"))
    target_bins = places.select(*side("_ty", "_tx")).distinct()
    climbing = target_bins.select("_by", "_bx", ladder).select(
        "_k", up("_by").alias("_ky"), up("_bx").alias("_kx"), F.col("_by").alias("_ty0"), F.col("_bx").alias("_tx0")
    )
    occupied = climbing.select("_k", "_ky", "_kx").distinct()
    point_bins = placed.select("_by", "_bx").distinct().select("_by", "_bx", ladder)
    lowest = (
        point_bins.select("*", up("_by").alias("_ky"), up("_bx").alias("_kx"))
        .join(dealt(occupied), ["_k", "_ky", "_kx"], "left_semi")
        .groupBy("_by", "_bx")
        .agg(F.least(F.min("_k") + 1, F.lit(top)).alias("_k"))
    )
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    block = lowest.select("*", F.explode(step).alias("_dy")).select("*", F.explode(step).alias("_dx"))
    block = block.select("_by", "_bx", "_k", (up("_by") + F.col("_dy")).alias("_ky"), (up("_bx") + F.col("_dx")).alias("_kx"))

    # bin to bin: closest and farthest two points of the bins can be, in bins
    ay, ax = F.abs(F.col("_ty0") - F.col("_by")), F.abs(F.col("_tx0") - F.col("_bx"))
    gy, gx = F.greatest(ay - 1, F.lit(0)).cast("double"), F.greatest(ax - 1, F.lit(0)).cast("double")
    fy, fx = (ay + 1).cast("double"), (ax + 1).cast("double")
    pairs = block.join(dealt(climbing), ["_k", "_ky", "_kx"]).select(
        "_by", "_bx", "_ty0", "_tx0", (gy * gy + gx * gx).alias("_near"), (fy * fy + fx * fx).alias("_far")
    )
    own = Window.partitionBy("_by", "_bx")
    useful = pairs.select("*", F.min("_far").over(own).alias("_reach")).where(F.col("_near") <= F.col("_reach"))
    members = places.select("_ty", "_tx", "_t", _bin(F.col("_ty"), size).alias("_ty0"), _bin(F.col("_tx"), size).alias("_tx0"))
    # bin to target: drop targets that some other target beats everywhere in the bin
    y0, x0 = F.col("_by") * size, F.col("_bx") * size
    square = lambda a, b: a * a + b * b
    gap = lambda c, low: F.greatest(low - F.col(c), F.col(c) - low - size, F.lit(0.0))
    far = lambda c, low: F.greatest(F.abs(F.col(c) - low), F.abs(F.col(c) - low - size))
    measured = (
        useful.select("_by", "_bx", "_ty0", "_tx0")
        .join(dealt(members), ["_ty0", "_tx0"])
        .select("_by", "_bx", "_ty", "_tx", "_t", square(gap("_ty", y0), gap("_tx", x0)).alias("_near"), square(far("_ty", y0), far("_tx", x0)).alias("_far"))
    )
    short = (
        measured.select("*", F.min("_far").over(own).alias("_reach"))
        .where(F.col("_near") <= F.col("_reach") * (1 + 1e-9))
        .groupBy("_by", "_bx")
        .agg(F.collect_list(F.struct("_ty", "_tx", "_t")).alias("_list"))
    )

    met = salted_join(placed, short, ["_by", "_bx"], [point_id])
    offset = lambda t: square(F.col("_py") - t["_ty"], F.col("_px") - t["_tx"])
    best = F.array_min(F.transform("_list", lambda t: F.struct(offset(t).alias("d2"), t["_t"].alias("t"))))
    return met.select(*points.columns, best.alias("_best")).select(
        *points.columns, *[F.col(f"_best.t.{c}").alias(c) for c in (target_id, *keep)], F.sqrt("_best.d2").alias("distance")
    )


def assign_fires(fires: DataFrame, cells: DataFrame, cap_deg: float = FIRE_CELL_CAP_DEG, fire_id: str = "fire_id") -> DataFrame:
    """Distinct (cell_id, date) of fires within ``cap_deg`` of their nearest cell."""
    hit = nearest(fires.select(fire_id, "lat", "lon", "date"), cells, fire_id, "cell_id")
    return hit.where(F.col("distance") < cap_deg).select("cell_id", "date").distinct()


def road_distance(cells: DataFrame, vertices: DataFrame, cap_km: float = 200.0, missing_km: float = 50.0) -> DataFrame:
    """Km to the nearest road vertex in scaled degrees, capped; no vertices at all gives the default."""
    scaled = (KM_PER_DEG, KM_PER_DEG_LON)
    hit = nearest(cells.select("cell_id", "lat", "lon"), vertices, "cell_id", "vertex_id", scale=scaled)
    found = hit.select("cell_id", F.least("distance", F.lit(cap_km)).alias("distance_to_road_km"))
    return cells.drop("distance_to_road_km").join(dealt(found), "cell_id", "left").fillna({"distance_to_road_km": missing_km})


def within_radius(
    points: DataFrame,
    targets: DataFrame,
    radius_km: Column | float = FIRE_RADIUS_KM,
    point_id: str = "cell_id",
    target_id: str = "fire_id",
    bin_deg: float = 0.2,
    split: str = "targets",
) -> DataFrame:
    """All (point, target) pairs within a radius in km, inclusive.

    Target columns must not collide with the point's, apart from ``lat`` and
    ``lon`` which become ``target_lat`` and ``target_lon``. A pair meets once. Of the two sides the one with more
    rows (``split``) lies in its own bins only and is salted where it clusters, the other is listed in all bins
    in reach: targets in bins of ``bin_deg``, points in bins half as wide as the next power of two of their radius.
    Only pairs in the box around a circle are measured.
    """
    radius = F.lit(radius_km) if isinstance(radius_km, (int, float)) else radius_km
    known = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    asked = known(points).withColumn("_r", radius.cast("double"))
    asked = asked.withColumns({"_ry": lat_reach_deg(F.col("_r")), "_rx": lon_reach_deg(F.col("lat"), F.col("_r"))})
    offered = known(targets).withColumnsRenamed({"lat": "target_lat", "lon": "target_lon"})
    if split == "targets":
        wide = 2 * bin_deg
        spread = asked.withColumn("_by", _bins("lat", F.col("_ry"), bin_deg)).withColumn("_bx", _bins("lon", F.col("_rx"), wide))
        binned = offered.withColumns({"_by": _bin(F.col("target_lat"), bin_deg), "_bx": _bin(F.col("target_lon"), wide)})
        met = salted_join(binned, spread, ["_by", "_bx"], [target_id])
    else:
        met = _points_once(asked, offered, point_id)
    inside = (F.abs(F.col("lat") - F.col("target_lat")) <= F.col("_ry")) & (F.abs(F.col("lon") - F.col("target_lon")) <= F.col("_rx"))
    return (
        met.where(inside)
        .withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon")))
        .where(F.col("distance_km") <= F.col("_r"))
        .drop("_by", "_bx", "_r", "_ry", "_rx")
    )


#: Least width of points' circles as a power of two of km, and points that one task measures in a bin.
LEAST_WIDTH, POINTS_PER_SALT = 4, 25_000


def _bins(place: str, reach: Column, size: Column | float) -> Column:
    """The bins that ``reach`` touches around a place."""
    return F.explode(F.sequence(_bin(F.col(place) - reach, size), _bin(F.col(place) + reach, size)))


def _points_once(points: DataFrame, targets: DataFrame, point_id: str) -> DataFrame:
    """Points (with ``_r``) in bins half as wide as their radius, and all targets that one of a bin may reach.

    The points are moved once, whatever their radius; a target is listed in some 25 bins for each width.
    """
    width = F.least(F.greatest(F.ceil(F.log2("_r")), F.lit(LEAST_WIDTH)), F.lit(15)).cast("int")
    high = F.pow(F.lit(2.0), F.col("_w") - 1) / KM_PER_DEG
    placed = points.withColumn("_w", width).withColumns({"_by": _bin(F.col("lat"), high), "_bx": _bin(F.col("lon"), 2 * high)})
    widths = F.broadcast(placed.select("_w").distinct())  # 12 rows at most
    most = F.pow(F.lit(2.0), F.col("_w"))
    up = lat_reach_deg(most)
    aside = lon_reach_deg(F.least(F.abs("target_lat") + up, F.lit(90.0)), most)  # as far as a point nearer to the pole reaches
    spread = targets.crossJoin(widths).withColumn("_by", _bins("target_lat", up, high)).withColumn("_bx", _bins("target_lon", aside, 2 * high))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return salted_join(placed, spread, ["_w", "_by", "_bx"], [point_id], rows_per_salt=POINTS_PER_SALT, tasks=tasks).drop("_w")


def within_degrees(points: DataFrame, targets: DataFrame, radius_deg: float, target_id: str) -> DataFrame:
    """Pairs within a radius in plain degrees (the buffer of J08), inclusive."""
    size = radius_deg
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (
        points.withColumn("_oy", F.explode(step)).withColumn("_ox", F.explode(step))
        .withColumns({"_by": _bin(F.col("lat"), size) + F.col("_oy"), "_bx": _bin(F.col("lon"), size) + F.col("_ox")})
        .drop("_oy", "_ox")
    )
    binned = targets.withColumnsRenamed({"lat": "target_lat", "lon": "target_lon"}).withColumns(
        {"_by": _bin(F.col("target_lat"), size), "_bx": _bin(F.col("target_lon"), size)}
    )
    dy, dx = F.col("lat") - F.col("target_lat"), F.col("lon") - F.col("target_lon")
    return (
        salted_join(binned, spread, ["_by", "_bx"], [target_id])
        .where(dy * dy + dx * dx <= radius_deg * radius_deg)
        .drop("_by", "_bx")
    )


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _days_mask(first: Column, last: Column) -> Column:
    """Days of a month as bits: day ``first`` to day ``last``."""
    upto = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    return upto(last) - upto(first - 1)


def holds_day(mask: Column, date: Column) -> Column:
    return F.call_function("shiftright", mask, F.dayofmonth(date) - 1).bitwiseAND(F.lit(1).cast("bigint")) == 1


def excluded_days(fire_cells: DataFrame, cells: DataFrame, radius_km: float = FIRE_RADIUS_KM, days: int = BUFFER_DAYS) -> DataFrame:
    """J08 as ``cell_id, month, mask``: the days near a fire in space and time, one bit each.

    A fire's days become at most a few rows (one per month touched) that are combined by OR, first
    per burned cell, then per cell around it; days are never listed one by one. Neighbours are found once
    per cell that ever burned, so the spatial work does not grow with the number of fires.
    """
    first, last = F.date_sub("date", days), F.date_add("date", days)
    months = F.explode(F.sequence(F.trunc(first, "MM"), last, F.expr("INTERVAL 1 MONTH"))).alias("_m")
    spans = fire_cells.select("cell_id", first.alias("_first"), last.alias("_last"), months)
    mask = _days_mask(F.dayofmonth(F.greatest("_first", "_m")), F.dayofmonth(F.least(F.col("_last"), F.last_day("_m"))))
    burned = spans.groupBy("cell_id", month_number(F.col("_m")).alias("month")).agg(F.bit_or(mask).alias("mask"))
    ever = fire_cells.select("cell_id").distinct().join(cells.select("cell_id", "lat", "lon"), "cell_id")
    around = within_degrees(
        ever.withColumnRenamed("cell_id", "fire_cell"), cells.select("cell_id", "lat", "lon"), radius_km / KM_PER_DEG, "cell_id"
    ).select("fire_cell", "cell_id")
    reached = around.join(burned.withColumnRenamed("cell_id", "fire_cell"), "fire_cell")
    return reached.groupBy("cell_id", "month").agg(F.bit_or("mask").alias("mask"))


def exclusion_zone(fire_cells: DataFrame, cells: DataFrame, radius_km: float = FIRE_RADIUS_KM, days: int = BUFFER_DAYS) -> DataFrame:
    """(cell_id, date) pairs near a fire in space and time, listed from the bits of ``excluded_days``."""
    masks = excluded_days(fire_cells, cells, radius_km, days)
    start = F.make_date(F.floor(F.col("month") / 12).cast("int"), F.pmod("month", F.lit(12)).cast("int") + 1, F.lit(1))
    listed = masks.select("cell_id", "mask", F.explode(F.sequence(start, F.last_day(start))).alias("date"))
    return listed.where(holds_day(F.col("mask"), F.col("date"))).select("cell_id", "date")


def outside_zone(days: DataFrame, masks: DataFrame) -> DataFrame:
    """The rows of ``days`` (``cell_id``, ``date``) that ``excluded_days`` doesn't hold."""
    met = days.withColumn("month", month_number(F.col("date"))).join(masks, ["cell_id", "month"], "left")
    free = F.col("mask").isNull() | ~holds_day(F.col("mask"), F.col("date"))
    return met.where(F.coalesce(free, F.lit(True))).select(*days.columns)


def zone_envelope(cells: DataFrame, pad_deg: float = 0.1) -> DataFrame:
    """One padded bounding box per zone (at most one row per zone of the fixed list)."""
    return cells.groupBy("bec_zone").agg(
        (F.min("lat") - pad_deg).alias("lat_min"),
        (F.max("lat") + pad_deg).alias("lat_max"),
        (F.min("lon") - pad_deg).alias("lon_min"),
        (F.max("lon") + pad_deg).alias("lon_max"),
    )


def in_zone_envelope(fires: DataFrame, envelope: DataFrame, bin_deg: float = 1.0) -> DataFrame:
    """Fires paired with every zone whose box holds them.

    Boxes are listed per bin, which bounds them by zones x bins of the covered
    area; that table is broadcast, so fires never move.
    """
    boxes = envelope.withColumn(
        "_by", F.explode(F.sequence(_bin(F.col("lat_min"), bin_deg), _bin(F.col("lat_max"), bin_deg)))
    ).withColumn("_bx", F.explode(F.sequence(_bin(F.col("lon_min"), bin_deg), _bin(F.col("lon_max"), bin_deg))))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    return (
        fires.withColumns({"_by": _bin(F.col("lat"), bin_deg), "_bx": _bin(F.col("lon"), bin_deg)})
        .join(F.broadcast(boxes), ["_by", "_bx"])
        .where(inside)
        .drop("_by", "_bx", "lat_min", "lat_max", "lon_min", "lon_max")
    )
