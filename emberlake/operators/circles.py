"""Totals of the fires in a circle around each cell without listing the pairs.

Spark deals cells and the fires in reach to tiles. Inside a tile the fires lie in rows of
small bins; what a circle covers of a row is one run of bins, whose totals are differences of
running sums (counts) and two looks into a table of maxima (sizes, first year). Only fires in
the bins under the circle's edge are measured one by one, so the work follows the
circumference and not the area.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.constants import EARTH_KM
from emberlake.functions.geo import lat_reach_deg, lon_reach_deg
from emberlake.operators.skew import hot_keys
from emberlake.session import by_value

by_value(__name__)

#: Cells and fires that one group holds; a tile with more is parted, as totals can be merged.
MOST_CELLS, MOST_FIRES = 20_000, 500_000
#: Cells looked at together, and distances measured at once.
BLOCK, BATCH = 1024, 2_000_000
#: Cells that a tile has on the mean, and how many times wider tiles may become for that.
FEW_CELLS, WIDEST = 256, 8
SLACK = 1e-9


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number of it, for all numbers of the ranges."""
    n = np.maximum(last - first, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[at]


def _merge(out: np.ndarray, at: np.ndarray, values: np.ndarray, f: np.ufunc) -> None:
    """Combine ``values`` into ``out`` at the ascending places ``at``."""
    if len(at):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] = f(out[at[starts]], f.reduceat(values, starts))


def _km(lat1, lon1, lat2, lon2):
    s1, s2 = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    a = s1 * s1 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * s2 * s2
    return np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0))) * (2 * EARTH_KM)


class _Rows:
    """Places in ``k`` rows of ``k`` bins, some two in a bin, in the order of rows and bins."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        self.k = k = int(np.clip(np.sqrt(len(lat) / 2), 1, 500))
        self.y0, self.x0 = lat.min(), lon.min()
        self.h, self.w = (max((v.max() - v.min()) / k, SLACK) * (1 + SLACK) for v in (lat, lon))
        row, col = ((v / size).astype(np.int64) for v, size in ((lat - self.y0, self.h), (lon - self.x0, self.w)))
        key = np.minimum(row, k - 1) * k + np.minimum(col, k - 1)
        self.order = np.argsort(key, kind="stable")
        self.lat, self.lon, self.key = lat[self.order], lon[self.order], key[self.order]
        self.first = np.searchsorted(self.key, np.arange(k * k + 1))

    def cut(self, lat: np.ndarray, lon: np.ndarray, radius: float):
        """For each point and row its circle touches: the point, the row, the bins touched and those wholly inside, as (from, to) each."""
        k, reach = self.k, np.degrees(radius / EARTH_KM) + SLACK
        place = lambda v, low, size: np.clip(np.floor((v - low) / size), 0, k).astype(np.int64)
        at, row = _spread(place(lat - reach, self.y0, self.h), np.minimum(place(lat + reach, self.y0, self.h) + 1, k))
        y, x = lat[at], lon[at]
        south = self.y0 + row * self.h - SLACK
        north = south + self.h + 2 * SLACK
        near, far = np.maximum(np.maximum(south - y, y - north), 0), np.maximum(np.abs(south - y), np.abs(north - y))
        ends = np.cos(np.radians(south)), np.cos(np.radians(north))
        least, most = np.maximum(np.minimum(*ends), 1e-12), np.where((south < 0) & (north > 0), 1.0, np.maximum(*ends))
        own = np.maximum(np.cos(np.radians(y)), 1e-12)
        left = lambda off: np.sin(radius / EARTH_KM / 2) ** 2 - np.sin(np.radians(off) / 2) ** 2
        half = lambda a: np.degrees(2 * np.arcsin(np.sqrt(np.clip(a, 0, 1))))
        a, b = left(near) / (own * least), left(far) / (own * most)
        out, inside = np.where(a >= 1, 360.0, half(a) + SLACK), half(b) - SLACK
        o0 = place(x - out, self.x0, self.w)
        o1 = np.minimum(place(x + out, self.x0, self.w) + 1, k)
        i0 = np.clip(np.ceil((x - inside - self.x0) / self.w), o0, o1).astype(np.int64)
        i1 = np.clip(np.floor((x + inside - self.x0) / self.w), o0, o1).astype(np.int64)
        none = (b <= 0) | (inside <= 0) | (i1 <= i0)
        return at, row, (o0, o1), (np.where(none, o1, i0), np.where(none, o1, i1))

    def measured(self, lat: np.ndarray, lon: np.ndarray, radius: float, at, first, last):
        """In batches: points and places in reach of each other among the ranges ``first`` to ``last`` of ``at``, with km."""
        sizes = np.cumsum(np.maximum(last - first, 0))
        for part in np.split(np.arange(len(at)), np.searchsorted(sizes, np.arange(BATCH, sizes[-1] if len(sizes) else 0, BATCH))):
            which, place = _spread(first[part], last[part])
            point = at[part][which]
            km = _km(lat[point], lon[point], self.lat[place], self.lon[place])
            hit = km <= radius
            yield point[hit], place[hit], km[hit]

    def maxima(self, values: np.ndarray) -> list[np.ndarray]:
        """Greatest value of runs of 1, 2, 4 ... bins of a row, by the run's first bin; ``values`` in this order."""
        k = self.k
        base = np.full(k * k, -np.inf)
        _merge(base, self.key, values, np.maximum)
        table = [base.reshape(k, k)]
        while 2 << (len(table) - 1) <= k:
            step, below = 1 << (len(table) - 1), table[-1]
            above = below.copy()
            above[:, : k - step] = np.maximum(below[:, : k - step], below[:, step:])
            table.append(above)
        return table


def _runs(tables: list[np.ndarray], row, first, last) -> np.ndarray:
    """Greatest value of the bins ``first`` to ``last`` (excluded, not empty) of a row."""
    level = np.frexp(last - first)[1] - 1
    out = np.empty(len(row))
    for i in np.unique(level):
        m = level == i
        out[m] = np.maximum(tables[i][row[m], first[m]], tables[i][row[m], last[m] - (1 << i)])
    return out


def _nearest(lat, lon, places: tuple[np.ndarray, np.ndarray], radius: float) -> np.ndarray:
    """Distance to the nearest place within the radius, or NaN, by circles that double."""
    best = np.full(len(lat), np.inf)
    if len(places[0]):
        rows = _Rows(*places)
        reach, open_ = min(max(rows.h * 111.2, radius / 64), radius), np.arange(len(lat))
        while len(open_):
            y, x, found = lat[open_], lon[open_], np.full(len(open_), np.inf)
            at, row, (o0, o1), _ = rows.cut(y, x, reach)
            for point, _, km in rows.measured(y, x, reach, at, rows.first[row * rows.k + o0], rows.first[row * rows.k + o1]):
                _merge(found, point, km, np.minimum)
            best[open_], open_ = found, open_[np.isinf(found)]
            if reach >= radius:
                break
            reach = min(reach * 2, radius)
    return np.where(np.isinf(best), np.nan, best)


def _block(lat, lon, rows: _Rows, fires: dict, tiers: dict[str, np.ndarray], tables: dict, radius: float):
    """Counts by cause and tier (cells x causes), and the greatest of each table, of the cells ``lat``, ``lon``."""
    n, causes = len(lat), fires["causes"]
    counts = {t: np.zeros((n, causes)) for t in tiers}
    most = {t: np.full(n, -np.inf) for t in tables}
    at, row, (o0, o1), (i0, i1) = rows.cut(lat, lon, radius)
    bins = row * rows.k
    edge_from, edge_to = (np.stack(p, 1).ravel() for p in ((rows.first[bins + o0], rows.first[bins + i1]), (rows.first[bins + i0], rows.first[bins + o1])))
    for point, place, _ in rows.measured(lat, lon, radius, np.repeat(at, 2), edge_from, edge_to):
        cell_cause = point * causes + fires["cause"][place]
        for t, holds in tiers.items():
            counts[t] += np.bincount(cell_cause, fires["fires"][place] * holds[place], n * causes).reshape(n, causes)
        for t in tables:
            _merge(most[t], point, fires[t][place], np.maximum)
    full = i1 > i0
    at, row, first, last = at[full], row[full], i0[full], i1[full]
    low, high = rows.first[row * rows.k + first], rows.first[row * rows.k + last]
    for t, holds in tiers.items():
        for c in range(causes):
            upto = np.r_[0, np.cumsum(fires["fires"] * holds * (fires["cause"] == c))]
            counts[t][:, c] += np.bincount(at, upto[high] - upto[low], n)
    for t in tables:
        _merge(most[t], at, _runs(tables[t], row, first, last), np.maximum)
    return counts, most


def _tile(cells: pd.DataFrame, fires: pd.DataFrame, radius: float, since: Mapping[str, int | None]) -> pd.DataFrame:
    """A row for each cell and cause with fires in the circle: counts of the cause, and over all causes nearest, largest and first year."""
    rows = _Rows(fires["lat"].to_numpy(float), fires["lon"].to_numpy(float))
    fires = fires.iloc[rows.order]
    code, names = pd.factorize(fires["cause"], use_na_sentinel=False)
    year = fires["year"].to_numpy(float)
    tiers = {t: np.ones(len(year), bool) if y is None else year >= y for t, y in since.items()}
    size = fires["size_ha"].to_numpy(float)
    size = np.where(np.isnan(size), -np.inf, size)
    held = {"causes": len(names), "cause": code, "fires": fires["fires"].to_numpy(float), "first": np.where(np.isnan(year), -np.inf, -year)}
    held |= {t: np.where(holds, size, -np.inf) for t, holds in tiers.items()}
    tables = {t: rows.maxima(held[t]) for t in (*tiers, "first")}
    lat, lon = cells["lat"].to_numpy(float), cells["lon"].to_numpy(float)
    near = {t: _nearest(lat, lon, (rows.lat[holds], rows.lon[holds]), radius) for t, holds in tiers.items()}
    out = []
    known = lambda v: np.where(np.isinf(v), np.nan, v)
    for i in range(0, len(lat), BLOCK):
        own = slice(i, i + BLOCK)
        counts, most = _block(lat[own], lon[own], rows, held, tiers, tables, radius)
        cell, cause = np.nonzero(sum(counts.values()))
        part = {"cell_id": cells["cell_id"].to_numpy()[own][cell], "cause": np.asarray(names, dtype=object)[cause]}
        for t in tiers:
            part |= {f"n_{t}": counts[t][cell, cause].astype(np.int64), f"near_{t}": near[t][own][cell], f"large_{t}": known(most[t])[cell]}
        out.append(pd.DataFrame(part | {"first_year": known(-most["first"])[cell]}))
    return pd.concat(out)


#: Columns of a cell whose box limits what its circle holds.
BOX = ["lat_min", "lat_max", "lon_min", "lon_max"]


def _by_box(cells: pd.DataFrame, fires: pd.DataFrame):
    """Cells and the fires of their box; cells whose boxes hold the same fires are taken together, as are all where the boxes cover the tile."""
    lat, lon = fires["lat"].to_numpy(float), fires["lon"].to_numpy(float)
    found: dict[bytes, list] = {}
    for (south, north, west, east), some in cells.groupby(BOX):
        held = (south <= lat) & (lat <= north) & (west <= lon) & (lon <= east)
        found.setdefault(held.tobytes(), [held, []])[1].append(some)
    return [(pd.concat(some), fires[held]) for held, some in found.values() if held.any()]


def circle_totals(
    cells: DataFrame, fires: DataFrame, radius_km: float, since: Mapping[str, int | None], tile_deg: float = 0.2, boxed: bool = False
) -> DataFrame:
    """Of the fires within ``radius_km`` of each cell, inclusive: ``n_``, ``near_`` and ``large_`` by tier, and ``first_year``.

    ``since`` has the first year of each tier, or None. ``fires`` holds lat, lon, year, cause, fires
    (their number) and size_ha. Counts are by cause, a row for each; the rest is over all
    causes and repeated. A crowded tile is parted over several groups, so a cell and cause may
    come several times: sums, minima and maxima of these rows are right. If ``boxed``, only fires in the box of a
    cell (its columns ``BOX``, inclusive) count, and cells without one have none.
    """
    box = BOX if boxed else []
    radius = F.lit(float(radius_km))
    whole = lambda value, size: F.floor(value / size).cast("bigint")
    known = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan(F.col("lat").cast("double")) & ~F.isnan(F.col("lon").cast("double")))
    tile = ["_ty", "_tx"]
    per_tile = known(cells).groupBy(whole(F.col("lat"), tile_deg), whole(F.col("lon"), 2 * tile_deg)).agg(F.count(F.lit(1)).alias("n"))
    mean = per_tile.agg(F.avg("n")).first()[0] or 1.0
    tile_deg *= float(np.clip(np.sqrt(FEW_CELLS / mean), 1, WIDEST))
    wide = 2 * tile_deg
    points = known(cells).select("cell_id", "lat", "lon", *box, whole(F.col("lat"), tile_deg).alias("_ty"), whole(F.col("lon"), wide).alias("_tx"))
    reach_y, reach_x = lat_reach_deg(radius), lon_reach_deg(F.col("lat"), radius)
    spread = (
        known(fires)
        .select("lat", "lon", "year", "cause", "fires", F.col("size_ha").cast("double").alias("size_ha"), reach_x.alias("_rx"))
        .withColumn("_ty", F.explode(F.sequence(whole(F.col("lat") - reach_y, tile_deg), whole(F.col("lat") + reach_y, tile_deg))))
        .withColumn("_tx", F.explode(F.sequence(whole(F.col("lon") - F.col("_rx"), wide), whole(F.col("lon") + F.col("_rx"), wide))))
        .drop("_rx")
    )
    parts = {"_f": (spread, MOST_FIRES, ["lat", "lon", "year", "cause"]), "_c": (points, MOST_CELLS, ["cell_id", "lat", "lon"])}
    for name, (df, step, _) in parts.items():
        crowded = F.broadcast(hot_keys(df.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n")), tile, step).withColumnRenamed("_salts", f"{name}n"))
        spread, points = (x.join(crowded, tile, "left") for x in (spread, points))
    number = lambda name: F.coalesce(F.col(f"{name}n"), F.lit(1))

    def dealt_out(df: DataFrame, own: str, other: str) -> DataFrame:
        salt = F.pmod(F.xxhash64(*parts[own][2]), number(own)).cast("int").alias(own)
        return df.select("*", salt).select("*", F.explode(F.sequence(F.lit(0), number(other) - 1)).alias(other)).drop("_fn", "_cn")

    group = [*tile, "_f", "_c"]
    names = dict(since)

    def totals(around: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(around) or not len(held):
            return pd.DataFrame(columns=columns)
        parts = _by_box(around, held) if boxed else [(around, held)]
        return pd.concat([_tile(*part, float(radius_km), names) for part in parts] or [pd.DataFrame(columns=columns)])

    kind = cells.schema["cell_id"].dataType.simpleString()
    by_tier = [f"n_{t} bigint, near_{t} double, large_{t} double" for t in names]
    schema = f"cell_id {kind}, cause string, {', '.join(by_tier)}, first_year int"
    columns = ["cell_id", "cause", *[f"{c}_{t}" for t in names for c in ("n", "near", "large")], "first_year"]
    # by number, so that a few rows that are much work aren't put together in one task
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(tasks, *group).groupBy(*group) for df in (dealt_out(points, "_c", "_f"), dealt_out(spread, "_f", "_c")))
    return left.cogroup(right).applyInPandas(totals, schema)
