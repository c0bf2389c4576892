"""Rasters as tables of pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.geo import pixel_col, pixel_row, tile_north, tile_west, tile_x, tile_y
from emberlake.functions.score import rgba


def pixel_index(df: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """Row and column of each point under a north-up affine grid (unclamped)."""
    return df.withColumns(
        {
            "row": F.floor((F.lit(north) - F.col("lat")) / step).cast("bigint"),
            "col": F.floor((F.col("lon") - F.lit(west)) / step).cast("bigint"),
        }
    )


def sample(points: DataFrame, raster: DataFrame, north: float, west: float, step: float, value: str = "value", nodata: float | None = None) -> DataFrame:
    """The pixel under each point; outside the raster or nodata is null."""
    pixels = raster if nodata is None else raster.withColumn(value, F.when(F.col(value) != nodata, F.col(value)))
    return pixel_index(points, north, west, step).join(pixels, ["row", "col"], "left").drop("row", "col")


def annual_vegetation(points: DataFrame, bands: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """Scaled vegetation features of a year; ``bands`` holds row, col, ndvi, snow, lai as stored."""
    got = pixel_index(points, north, west, step).join(bands, ["row", "col"], "left")
    return got.select(
        *points.columns,
        F.coalesce(F.col("ndvi") * 0.0001, F.lit(0.5)).alias("ndvi"),
        F.coalesce((F.col("snow") > 50).cast("double"), F.lit(0.0)).alias("snow_cover"),
        F.coalesce(F.col("lai") * 0.1, F.lit(2.0)).alias("lai"),
    )


def usable(value: Column) -> Column:
    """Finite and above the elevation sentinel."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))) & (v > -9999)


def rasterize(cells: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per pixel, the sum of usable values over the number of cells that fall in it."""
    return cells.groupBy(*keys, "row", "col").agg(
        *[(F.sum(F.when(usable(F.col(c)), F.col(c)).otherwise(0.0)) / F.count(F.lit(1))).alias(c) for c in values]
    )


def fire_mask(fire_cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 for pixels with any burning cell."""
    return fire_cells.select(*keys, "row", "col").distinct().withColumn("fire", F.lit(1))


def last_cell_raster(cells: DataFrame, value: str, height: int, width: int, north: float, south: float, west: float, east: float) -> DataFrame:
    """A12, single-key form: the last cell (largest id) wins a pixel; cells outside fall away."""
    row = F.floor((north - F.col("lat")) / ((north - south) / height)).cast("bigint")
    col = F.floor((F.col("lon") - west) / ((east - west) / width)).cast("bigint")
    placed = cells.where(F.col(value).isNotNull()).withColumns({"row": row, "col": col})
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return placed.where(inside).groupBy("row", "col").agg(F.max_by(value, "cell_id").alias(value))


def channel_stats(pixels: DataFrame, land: DataFrame, channels: Sequence[str], last_year: int) -> DataFrame:
    """Mean and deviation over all land pixels of all days; absent pixels count as 0."""
    train = pixels.where(F.year("date") <= last_year)
    on_land = train.join(land.select("row", "col").distinct(), ["row", "col"], "left_semi")
    n_land = land.select("row", "col").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    n_days = train.select("date").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = on_land.agg(
        *[F.sum(c).alias(f"s_{c}") for c in channels], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in channels]
    )
    counted = sums.withColumn("_total", (n_land * n_days).cast("double"))
    stats = []
    for c in channels:
        mean = F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) / F.col("_total")
        var = F.coalesce(F.col(f"q_{c}"), F.lit(0.0)) / F.col("_total") - mean * mean
        std = F.sqrt(F.greatest(var, F.lit(0.0)))
        stats.append(F.struct(F.lit(c).alias("channel"), mean.alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std")))
    return counted.select(F.inline(F.array(*stats)))


def normalise(pixels: DataFrame, stats: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Z-scores; the statistics are one row per channel of the fixed list."""
    pair = lambda c: F.max(F.when(F.col("channel") == c, F.struct("mean", "std"))).alias(c)
    of = stats.agg(F.struct(*[pair(c) for c in channels])).scalar()
    known = pixels.withColumn("_s", of)
    return known.withColumns({c: (F.col(c) - F.col(f"_s.{c}.mean")) / F.col(f"_s.{c}.std") for c in channels}).drop("_s")


def annual_composites(scenes: DataFrame) -> DataFrame:
    """Yearly median NDVI and LAI and maximum snow per pixel.

    ``scenes`` has one row per (pixel, date); the dates of a year bound the group.
    """
    return scenes.groupBy("row", "col", F.year("date").alias("year")).agg(
        F.median("ndvi").alias("ndvi"), F.median("lai").alias("lai"), F.max("snow").alias("snow")
    )


def fine_ndvi(scenes: DataFrame, max_cloud: float = 20.0) -> DataFrame:
    """NDVI from May-September medians of red and near infrared of clear scenes (end date exclusive)."""
    clear = scenes.where((F.col("cloud_pct") < max_cloud) & (F.date_format("date", "MM-dd").between("05-01", "09-29")))
    med = clear.groupBy("row", "col", F.year("date").alias("year")).agg(F.median("b8").alias("b8"), F.median("b4").alias("b4"))
    return med.withColumn("ndvi", F.try_divide(F.col("b8") - F.col("b4"), F.col("b8") + F.col("b4")))


def terrain(dem: DataFrame, height: int, width: int, step_deg: float, value: str = "value") -> DataFrame:
    """Slope, aspect and hillshade (sun at 315/45) from a dense elevation raster.

    Central differences, one-sided on the rim, missing pixels as 0. Windows span
    one raster row or column.
    """
    along_row, along_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    z = F.coalesce(F.when(~F.isnan(F.col(value)), F.col(value)), F.lit(0.0))
    spacing = step_deg * 111000.0

    def neighbour(fn, axis: str, window, offset: int) -> Column:
        adjacent = fn(axis, 1).over(window) == F.col(axis) + offset
        return F.when(adjacent, fn("_z", 1).over(window)).otherwise(F.lit(0.0))

    def slope_along(axis: str, window, size: int) -> Column:
        before, after = neighbour(F.lag, axis, window, -1), neighbour(F.lead, axis, window, 1)
        return (
            F.when(F.lit(size == 1), F.lit(0.0))
            .when(F.col(axis) == 0, (after - F.col("_z")) / spacing)
            .when(F.col(axis) == size - 1, (F.col("_z") - before) / spacing)
            .otherwise((after - before) / (2.0 * spacing))
        )

    graded = dem.withColumn("_z", z).withColumn("_dx", slope_along("col", along_row, width)).withColumn("_dy", slope_along("row", along_col, height))
    slope = F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    aspect = F.atan2(-F.col("_dy"), F.col("_dx"))
    alt, az = math.radians(45.0), math.radians(315.0)
    shade = F.cos(slope) * math.cos(alt) + F.sin(slope) * math.sin(alt) * F.cos(F.lit(az) - aspect)
    return graded.select(
        *dem.columns,
        F.degrees(slope).alias("slope_deg"),
        F.pmod(F.degrees(aspect) + 360.0, F.lit(360.0)).alias("aspect_deg"),
        F.least(F.greatest(shade * 255.0, F.lit(0.0)), F.lit(255.0)).alias("hillshade"),
    )


def _smear(df: DataFrame, axis: str, other: str, size: int, kernel: int) -> DataFrame:
    """Spread every pixel over the outputs whose window sees it, along one axis.

    Windows reach beyond the rim into the mirrored raster, so a pixel also counts
    through its mirror images.
    """
    left, right = kernel // 2, kernel - 1 - kernel // 2
    i = F.col(axis)
    images = F.array(i, -1 - i, 2 * size - 1 - i)
    reach = F.explode(F.sequence(F.lit(-right), F.lit(left)))
    spread = df.withColumn("_j", F.explode(images)).withColumn("_d", reach).withColumn("_o", F.col("_j") + F.col("_d"))
    return (
        spread.where(F.col("_o").between(0, size - 1))
        .groupBy(F.col("_o").alias(axis), other)
        .agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    )


def heatmap(cells: DataFrame, south: float, west: float, north: float, east: float, width: int, height: int) -> DataFrame:
    """Smoothed scores of a box as pixels with colours.

    Cells map to pixels (the largest cell_id wins one), then a box mean over the
    covered pixels is taken as two one-axis sums; every pixel of the frame comes
    out, uncovered ones with score 0.
    """
    kernel = max(3, int(min(width, height) / 20))
    boxed = cells.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    pixels = boxed.groupBy(
        pixel_row(F.col("lat"), north, south, height).alias("row"), pixel_col(F.col("lon"), west, east, width).alias("col")
    ).agg(F.max_by("score", "cell_id").alias("v"))
    weighted = pixels.withColumn("w", F.lit(1))
    smooth = _smear(_smear(weighted, "row", "col", height, kernel), "col", "row", width, kernel)
    frame = cells.sparkSession.range(height * width).select(
        F.floor(F.col("id") / width).cast("bigint").alias("row"), (F.col("id") % width).alias("col")
    )
    score = F.coalesce(F.least(F.greatest(F.col("v") / F.col("w"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return frame.join(smooth, ["row", "col"], "left").select("row", "col", score.alias("score")).withColumn("rgba", rgba(F.col("score"), "above"))


def tiles(cells: DataFrame, zooms: Sequence[int], resolution_km: float = 5.0, tile_size: int = 256) -> DataFrame:
    """Painted pixels of all tiles of the zooms.

    A cell belongs to every tile whose box holds it (two for a point on a shared
    edge) and paints a block there, cut at the tile's rim. Where blocks overlap the
    largest cell_id wins, by a combiner.
    """
    zoomed = cells.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    fx = tile_x(F.col("lon"), F.col("z"))
    xs = F.array_distinct(F.array(F.ceil(fx) - 1, F.floor(fx)))
    placed = zoomed.withColumn("x", F.explode(xs)).withColumn("y", F.floor(tile_y(F.col("lat"), F.col("z"))))
    boxed = placed.withColumns(
        {
            "_w": tile_west(F.col("x"), F.col("z")),
            "_e": tile_west(F.col("x") + 1, F.col("z")),
            "_n": tile_north(F.col("y"), F.col("z")),
            "_s": tile_north(F.col("y") + 1, F.col("z")),
        }
    ).where(F.col("lat").between(F.col("_s"), F.col("_n")) & F.col("lon").between(F.col("_w"), F.col("_e")))
    last = tile_size - 1
    row = F.least(F.floor((F.col("_n") - F.col("lat")) / ((F.col("_n") - F.col("_s")) / tile_size)), F.lit(last))
    col = F.least(F.floor((F.col("lon") - F.col("_w")) / ((F.col("_e") - F.col("_w")) / tile_size)), F.lit(last))
    half = F.floor(F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.col("z")) * (resolution_km * 0.02))) / 2)
    span = lambda c: F.sequence(F.greatest(c - half, F.lit(0)), F.least(c + half, F.lit(last)))
    painted = boxed.withColumns({"_r": row, "_c": col}).withColumn("py", F.explode(span(F.col("_r")))).withColumn("px", F.explode(span(F.col("_c"))))
    done = painted.groupBy("z", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "py", "px").agg(
        F.max_by("score", "cell_id").alias("score")
    )
    return done.withColumn("rgba", rgba(F.col("score"), "below"))
