"""Long-term fire statistics per cell and zone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.constants import FIRE_RADIUS_KM, SEASON_DAYS_10YR
from emberlake.functions.score import percentile_label
from emberlake.operators.circles import circle_totals
from emberlake.operators.skew import dealt, group_median, running_totals, salted_join
from emberlake.operators.spatial import in_zone_envelope, within_radius, zone_envelope
from emberlake.session import materialize

TIERS = {"10yr": 10, "30yr": 30, "all": None}


def merge_copies(fires: DataFrame) -> DataFrame:
    """Fires at one place, year and cause as one row with their count and largest size.

    Every statistic below needs only these, and a place that repeats thousands of
    times then crosses the network once.
    """
    return fires.groupBy("lat", "lon", "year", "cause").agg(
        F.count(F.lit(1)).alias("fires"), F.max("size_ha").alias("size_ha"), F.min("fire_id").alias("fire_id")
    )


def _tier(year: int, span: int | None) -> Column:
    return F.lit(True) if span is None else F.col("year") >= year - span


def tier_summary(cells: DataFrame, pairs: DataFrame, as_of_year: int) -> DataFrame:
    """Count, nearest, largest and causes for 10 years, 30 years and all time.

    ``pairs`` holds cell_id, year, cause, fires, size_ha and distance_km. Cells
    without fires get 0, null, null and an empty map.
    """
    return tiers_of(cells, by_cause(pairs, as_of_year))


def by_cause(pairs: DataFrame, as_of_year: int) -> DataFrame:
    """A01 by cell and cause, from the pairs."""
    return pairs.groupBy("cell_id", "cause").agg(
        *[
            expr
            for name, span in TIERS.items()
            for expr in (
                F.sum(F.when(_tier(as_of_year, span), F.col("fires"))).alias(f"n_{name}"),
                F.min(F.when(_tier(as_of_year, span), F.col("distance_km"))).alias(f"near_{name}"),
                F.max(F.when(_tier(as_of_year, span), F.col("size_ha"))).alias(f"large_{name}"),
            )
        ],
        F.min("year").alias("first_year"),
    )


def tiers_of(cells: DataFrame, per_cause: DataFrame) -> DataFrame:
    """A01 from totals by cell and cause; several rows of one cell and cause count together."""
    per_cause = per_cause.groupBy("cell_id", "cause").agg(
        *[f(f"{c}_{name}").alias(f"{c}_{name}") for name in TIERS for c, f in (("n", F.sum), ("near", F.min), ("large", F.max))],
        F.min("first_year").alias("first_year"),
    )
    per_cell = per_cause.groupBy("cell_id").agg(
        *[
            expr
            for name in TIERS
            for expr in (
                F.sum(f"n_{name}").alias(f"n_{name}"),
                F.min(f"near_{name}").alias(f"near_{name}"),
                F.max(f"large_{name}").alias(f"large_{name}"),
                # one entry per cause of the fixed list
                F.collect_list(
                    F.when(F.col("cause").isNotNull() & (F.col(f"n_{name}") > 0), F.struct("cause", F.col(f"n_{name}")))
                ).alias(f"causes_{name}"),
            )
        ],
        F.min("first_year").alias("record_start"),
    )
    tiers = [
        F.struct(
            F.coalesce(f"n_{name}", F.lit(0)).cast("bigint").alias("count"),
            F.col(f"near_{name}").alias("nearest_km"),
            F.col(f"large_{name}").alias("largest_ha"),
            F.coalesce(
                F.map_from_entries(f"causes_{name}"), F.create_map().cast("map<string,bigint>")
            ).alias("causes"),
        ).alias(f"fires_{name}")
        for name in TIERS
    ]
    return cells.join(dealt(per_cell), "cell_id", "left").select(*cells.columns, *tiers, "record_start")


def fire_rates(tiers: DataFrame) -> DataFrame:
    """Fires per cell and season day, for each (zone, fuel) and each zone in one pass.

    ``fuel_type`` is null on the zone rows. Rows are bounded by zones x fuels.
    """
    count = F.col("fires_10yr.count")
    flat = tiers.select("bec_zone", "fuel_type", count.alias("n"))
    return flat.groupingSets(
        [["bec_zone", "fuel_type"], ["bec_zone"]], "bec_zone", "fuel_type"
    ).agg(
        F.grouping("fuel_type").alias("is_zone"),
        F.count(F.lit(1)).alias("cells"),
        (F.sum("n") / (F.count(F.lit(1)) * SEASON_DAYS_10YR)).alias("rate"),
    )


def susceptibility(tiers: DataFrame, rates: DataFrame) -> DataFrame:
    """Cell rate with 2 fires or more, else the group's, else the zone's; unburned cells are capped."""
    groups = rates.where(F.col("is_zone") == 0).select(
        "bec_zone", "fuel_type", F.col("cells").alias("_gcells"), F.col("rate").alias("_grate")
    )
    zones = rates.where(F.col("is_zone") == 1).select("bec_zone", F.col("rate").alias("_zrate"))
    joined = tiers.join(F.broadcast(groups), ["bec_zone", "fuel_type"], "left").join(F.broadcast(zones), "bec_zone", "left")
    n = F.col("fires_10yr.count")
    zone_rate = F.coalesce("_zrate", F.lit(0.0))
    by_group = F.coalesce(F.col("_gcells") >= 10, F.lit(False))
    inherited = F.when(by_group, F.col("_grate")).otherwise(zone_rate)
    source = F.when(by_group, "bec_fuel").otherwise("bec")
    capped = (n == 0) & (inherited > zone_rate * 0.5)
    score = F.when(n >= 2, n / F.lit(float(SEASON_DAYS_10YR))).when(capped, zone_rate * 0.5).otherwise(inherited)
    basis = F.when(n >= 2, "cell").when(capped, F.concat(source, F.lit("_dampened"))).otherwise(source)
    return joined.withColumns({"susceptibility_score": score, "susceptibility_basis": basis}).drop("_gcells", "_grate", "_zrate")


def percentile_of(df: DataFrame, names: dict[str, str], row_id: str = "cell_id") -> DataFrame:
    """round(100 * rows strictly below / rows), half to even, at most 100.

    ``names`` maps a value column to its percentile column. A rank comes from
    totals over distinct values; it is joined back by value, salted because one
    value may belong to a third of the rows. ``df`` should be a stored table: it is
    read once per value and once more.
    """
    out = df
    for value, name in names.items():
        ranked = running_totals(df.select(value), value, {"n": F.count(F.lit(1))})
        pct = F.least(F.bround(F.col("n_before") / F.col("n_all") * 100.0, 0), F.lit(100.0)).cast("int")
        counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
        out = salted_join(out, ranked.select(value, pct.alias(name)), [value], [row_id], "left", counts=counts)
    return out


def keep_first_fire(fires: DataFrame) -> DataFrame:
    """One fire per (lat, lon, year); the smallest fire_id stands for input order."""
    first = fires.groupBy("lat", "lon", "year").agg(F.min_by(F.struct("fire_id", "size_ha", "cause"), "fire_id").alias("f"))
    return first.select("lat", "lon", "year", "f.*")


def fire_regime(cells: DataFrame, fires: DataFrame, as_of_year: int, cell_area_ha: float = 100.0) -> DataFrame:
    """Return interval, severity by median size, dominant cause, per zone.

    Fires belong to every zone whose padded envelope holds them. Medians and modes
    come from grouped counts, so a zone with most of the fires is never one task.
    """
    unique = keep_first_fire(fires)
    zoned = in_zone_envelope(unique, zone_envelope(cells)).select("bec_zone", "size_ha", "cause")
    zoned = materialize(zoned, "zoned-fires")  # read for sums, medians and modes
    years = fires.agg(F.greatest(F.lit(as_of_year) - F.min("year"), F.lit(1)).alias("y")).scalar()
    burned = zoned.groupBy("bec_zone").agg(F.sum("size_ha").alias("_burned"))
    middle = group_median(zoned, "size_ha", ["bec_zone"], "_median")
    causes = (
        zoned.where(F.col("cause").isNotNull())
        .groupBy("bec_zone", "cause")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("bec_zone")
        .agg(F.min_by("cause", F.struct(-F.col("_n"), "cause")).alias("_cause"))
    )
    area = cells.groupBy("bec_zone").agg((F.count(F.lit(1)) * cell_area_ha).alias("_area"))
    joined = area.join(burned, "bec_zone", "left").join(middle, "bec_zone", "left").join(causes, "bec_zone", "left")
    rate = F.col("_burned") / F.coalesce(years, F.lit(1))
    return joined.select(
        "bec_zone",
        F.when(rate > 0, F.col("_area") / rate).alias("mean_return_years"),
        F.when(F.col("_median") > 1000, "high").when(F.col("_median") >= 100, "moderate").otherwise("low").alias("typical_severity"),
        F.coalesce("_cause", F.lit("unknown")).alias("dominant_cause"),
    )


def matched_fires(
    cells: DataFrame, fires: DataFrame, radius_km: float = FIRE_RADIUS_KM, parity_envelope: bool = False, since: Mapping[str, int | None] | None = None
) -> DataFrame:
    """J05 for statistics; ``parity_envelope`` also drops pairs outside the zone's padded box.

    The pairs grow with the square of the tables. With ``since`` (the first year of each tier, or None) they
    aren't listed: totals by cell and cause come back, as of ``circle_totals``.
    """
    copies = merge_copies(fires)
    if parity_envelope:
        box = F.broadcast(zone_envelope(cells))
    if since is not None:
        asked = cells.join(box, "bec_zone") if parity_envelope else cells
        return circle_totals(asked, copies, radius_km, since, boxed=parity_envelope)
    pairs = within_radius(cells.select("cell_id", "bec_zone", "lat", "lon"), copies, radius_km)
    if parity_envelope:
        inside = F.col("target_lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("target_lon").between(
            F.col("lon_min"), F.col("lon_max")
        )
        pairs = pairs.join(box, "bec_zone").where(inside)
    return pairs.select("cell_id", "year", "cause", "fires", "size_ha", "distance_km")


def cell_tiers(cells: DataFrame, fires: DataFrame, as_of_year: int, parity_envelope: bool = False) -> DataFrame:
    """A01 for every cell, stored: rates, susceptibility and ranks all read it again."""
    base = cells.select("cell_id", "lat", "lon", "bec_zone", "fuel_type")
    since = {name: None if span is None else as_of_year - span for name, span in TIERS.items()}
    return materialize(tiers_of(base, matched_fires(base, fires, parity_envelope=parity_envelope, since=since)), "fire-tiers")


def fire_statistics(cells: DataFrame, fires: DataFrame, as_of_year: int, parity_envelope: bool = False, cell_area_ha: float = 100.0) -> DataFrame:
    """Q03: the full statistics row of every cell."""
    tiers = cell_tiers(cells, fires, as_of_year, parity_envelope)
    rated = susceptibility(tiers, fire_rates(tiers)).withColumn("_exposure", F.col("fires_10yr.count"))
    stored = materialize(rated, "fire-rates")
    ranked = percentile_of(stored, {"susceptibility_score": "susceptibility_percentile", "_exposure": "exposure_percentile"})
    regime = fire_regime(cells, fires, as_of_year, cell_area_ha)
    return (
        ranked.withColumn("susceptibility_label", percentile_label(F.col("susceptibility_percentile")))
        .join(F.broadcast(regime), "bec_zone", "left")
        .drop("_exposure")
    )
