"""Nearest targets by descending two trees of bins together, one over the points and one over the targets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.skew import dealt
from emberlake.session import materialize

#: Targets that a bin of points may have to choose from; bins with more are split.
MOST = 160
#: Halvings of the whole area below which bins are not split.
DEEPEST = 30


class _Area:
    """The square (or cube) that holds all points and targets, and its bins: halved ``level`` times."""

    def __init__(self, lows: list[float], highs: list[float]):
        self.lows, self.dims = lows, range(len(lows))
        # a little wider, so that the last place is inside
        self.side = max((h - low for low, h in zip(lows, highs, strict=True)), default=1.0) * (1 + 1e-9) or 1.0
        # the first level has some hundred bins with places; from there on each bin is cut into 4 by 4 (by 4)
        self.first, self.bits = (4 if len(lows) == 2 else 3), 2

    def bin(self, value: str, i: int, level: Column | int) -> Column:
        # a power of two scales exactly, so bins of all levels nest
        return F.floor((F.col(value) - self.lows[i]) / self.side * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)).cast("bigint")

    def each(self, *prefixes: str) -> list[str]:
        return [f"{p}{i}" for p in prefixes for i in self.dims]


def _total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _square_gap(place, box) -> Column:
    """Squared distance between two boxes given as (low, high) by dimension; 0 where they meet."""
    gaps = [F.greatest(low - h, c - high, F.lit(0.0)) for (c, h), (low, high) in zip(place, box, strict=True)]
    return _total(g * g for g in gaps)


def _boxes(area: _Area, kind: str):
    return [(F.col(f"_{kind}l{i}"), F.col(f"_{kind}h{i}")) for i in area.dims]


def _pruned(pairs: DataFrame, area: _Area, k: int, slack: float) -> DataFrame:
    """Leave out, for each bin of points, the bins (or targets) that can't hold one of the ``k`` nearest of any of its points.

    The farthest that the nearest bins can be bounds how near the others must come. For the
    very nearest a second test is sharper: a bin goes if one known target is nearer from all
    corners of the points' bin, and then it is so from every place between them.
    """
    own = Window.partitionBy("_lq", *area.each("_q"))
    points, nodes = _boxes(area, "q"), _boxes(area, "n")
    ends = [F.greatest(nh - ql, qh - nl) for (ql, qh), (nl, nh) in zip(points, nodes, strict=True)]
    pairs = pairs.withColumns({"_near": _square_gap(points, nodes), "_far": _total(e * e for e in ends)})
    if k == 1:
        centre = [(low + high) / 2 for low, high in points]
        off = _total((c - F.col("_r")[f"_t{i}"]) * (c - F.col("_r")[f"_t{i}"]) for i, c in zip(area.dims, centre, strict=True))
        seen = pairs.withColumns({"_reach": F.min("_far").over(own), "_pivot": F.min(F.struct(off.alias("d"), F.col("_r").alias("r"))).over(own)["r"]})
        beaten = F.lit(True)
        for corner in product(*points):
            to_pivot = _total((c - F.col("_pivot")[f"_t{i}"]) * (c - F.col("_pivot")[f"_t{i}"]) for i, c in zip(area.dims, corner, strict=True))
            beaten &= to_pivot * (1 + 1e-9) < _square_gap([(c, c) for c in corner], nodes)
        seen = seen.where(~beaten)
    else:
        upto = own.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
        seen = pairs.withColumn("_held", F.sum("_count").over(upto)).withColumn("_reach", F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(own))
    reach = F.sqrt("_reach") + slack
    return seen.where(F.col("_reach").isNull() | (F.col("_near") <= reach * reach * (1 + 1e-9))).drop("_near", "_far", "_pivot", "_held")


def _point_bins(placed: DataFrame, area: _Area, level: int) -> DataFrame:
    """The bins of a level that hold points, with the box around those and the bin one step up (above the first level: all)."""
    edges = [f(f"_p{i}").alias(f"_q{e}{i}") for i in area.dims for f, e in ((F.min, "l"), (F.max, "h"))]
    bins = placed.groupBy(*[area.bin(f"_p{i}", i, level).alias(f"_q{i}") for i in area.dims]).agg(*edges)
    up = {f"_pq{i}": F.shiftright(f"_q{i}", area.bits if level > area.first else area.first) for i in area.dims}
    return bins.withColumns({"_lq": F.lit(level), "_plq": F.lit(level - area.bits)} | up)


def _target_bins(places: DataFrame, area: _Area, level: int) -> DataFrame:
    edges = [f(f"_t{i}").alias(f"_n{e}{i}") for i in area.dims for f, e in ((F.min, "l"), (F.max, "h"))]
    some = F.min(F.struct(*area.each("_t"))).alias("_r")
    bins = places.groupBy(*[area.bin(f"_t{i}", i, level).alias(f"_n{i}") for i in area.dims]).agg(F.count(F.lit(1)).alias("_count"), some, *edges)
    return bins.withColumns({f"_pn{i}": F.shiftright(f"_n{i}", area.bits if level > area.first else area.first) for i in area.dims})


def candidate_bins(placed: DataFrame, places: DataFrame, area: _Area, k: int, slack: float, most: int) -> list[DataFrame]:
    """Bins of points with the bins of targets their nearest can be in, a written table per level of the latter.

    All bins of points start at the top with all bins of targets. Step by step the targets' bins
    are split, and the points' bins too as long as they are wide against the distances (for
    several nearest: as long as they hold different places), until what is left holds at most ``most`` targets.
    A step joins bins with their own parts only, so its work follows the pairs that stay.
    """
    q_box, q, n = area.each("_ql", "_qh"), area.each("_q"), area.each("_n")
    columns = ["_lq", *q, *q_box, *n, *area.each("_nl", "_nh"), "_count", "_r"]
    level = area.first
    pairs = _point_bins(placed, area, level).withColumnsRenamed({f"_pq{i}": f"_pn{i}" for i in area.dims}).join(dealt(_target_bins(places, area, level)), area.each("_pn"))
    out = []
    while True:
        own = Window.partitionBy("_lq", *q)
        total = F.sum("_count").over(own)
        wide = _total((F.col(f"_qh{i}") - F.col(f"_ql{i}")) * (F.col(f"_qh{i}") - F.col(f"_ql{i}")) for i in area.dims)
        splits = wide * 16 > F.col("_reach") if k == 1 else wide > 0
        marked = _pruned(pairs.select(*columns), area, k, slack).select(*columns, (total <= most).alias("_done"), F.coalesce(splits, wide > 0).alias("_splits"))
        step = materialize(marked.withColumn("_ln", F.lit(level)), "bin-pairs")
        out.append(step if level + area.bits > DEEPEST else step.where("_done"))
        left = step.where(~F.col("_done"))
        kinds = left.select("_lq", "_splits").distinct().collect() if level + area.bits <= DEEPEST else []  # at most two a level
        if not kinds:
            return out
        level += area.bits
        parts = left.where(~F.col("_splits")).select(*columns)
        if levels := sorted(x for x, splits in kinds if splits):
            children = reduce(DataFrame.unionByName, [_point_bins(placed, area, x + area.bits) for x in levels])
            parents = left.where("_splits").drop(*q_box).withColumnsRenamed({"_lq": "_plq"} | {f"_q{i}": f"_pq{i}" for i in area.dims})
            split = parents.join(dealt(children), ["_plq", *area.each("_pq")]).select(*columns)
            parts = parts.unionByName(_pruned(split, area, k, slack).select(*columns))
        above = parts.select("_lq", *q, *q_box, *[F.col(f"_n{i}").alias(f"_pn{i}") for i in area.dims])
        pairs = above.join(dealt(_target_bins(places, area, level)), area.each("_pn"))


def k_nearest(
    points: DataFrame,
    targets: DataFrame,
    point_at: Sequence[Column],
    target_at: Sequence[Column],
    target_id: str,
    k: int = 1,
    keep: Sequence[str] = (),
    slack: float = 0.0,
    most: int = MOST,
) -> DataFrame:
    """The columns of ``points`` and ``_near``, an array of ``(d2, t)``: squared distance, and the target's id and ``keep`` columns.

    Exact: it holds the ``k`` nearest of the point (equal distances: the least ids first) in order, and with
    ``slack`` all that come within it of the ``k``-th, in the worst case some more. Distances are Euclidean in
    the given coordinates, two or three; points and targets without coordinates are left out.

    The search is planned for bins of points (``candidate_bins``); each ends with a short list
    of targets. Points meet the list of their bin in one join; they are neither grouped nor
    multiplied by targets. Targets that lie in one
    small spot only deepen the tree there.
    """
    dims = range(len(point_at))
    known = lambda cs: reduce(lambda a, b: a & b, [c.isNotNull() for c in cs])
    placed = points.where(known(point_at)).select("*", *[c.cast("double").alias(f"_p{i}") for i, c in enumerate(point_at)])
    t = F.struct(target_id, *keep)
    spots = targets.where(known(target_at)).select(*[c.cast("double").alias(f"_t{i}") for i, c in enumerate(target_at)], t.alias("_t"))
    at = [f"_t{i}" for i in dims]
    if k == 1:
        spots = spots.groupBy(*at).agg(F.min("_t").alias("_t"))
    else:  # of copies at one place the k least can count
        rank = F.row_number().over(Window.partitionBy(*at).orderBy("_t"))
        spots = spots.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    placed, places = materialize(placed, "points"), materialize(spots, "targets")
    all_places = placed.select(*[f"_p{i}" for i in dims]).union(places.select(*at))
    ends = all_places.agg(*[f(f"_p{i}") for f in (F.min, F.max) for i in dims]).first()
    ends = [0.0 if x is None else x for x in ends]
    area = _Area(ends[: len(dims)], ends[len(dims) :])
    q, n = area.each("_q"), area.each("_n")

    steps = candidate_bins(placed, places, area, k, slack, most)
    found = reduce(DataFrame.unionByName, steps)
    levels = F.explode(F.array(*[F.lit(area.first + area.bits * i) for i in range(len(steps))])).alias("_ln")
    members = places.select("*", levels).withColumns({f"_n{i}": area.bin(f"_t{i}", i, F.col("_ln")) for i in dims})
    box = {f"_n{e}{i}": F.col(f"_t{i}") for i in dims for e in "lh"} | {"_count": F.lit(1), "_r": F.struct(*at)}
    met = found.select("_lq", *q, *area.each("_ql", "_qh"), "_ln", *n).join(dealt(members), ["_ln", *n]).withColumns(box)
    lists = _pruned(met, area, k, slack).groupBy("_lq", *q).agg(F.collect_list(F.struct(*at, "_t")).alias("_list"))
    lists = materialize(lists, "target-lists")

    # which levels a point's bin can be of: known for each bin of a coarse level, a table of bounded size
    coarse = area.first + area.bits
    places_in = F.sequence(F.lit(0), F.when(F.col("_lq") < coarse, (1 << area.bits) - 1).otherwise(0))
    spread_out = reduce(lambda df, i: df.withColumn(f"_o{i}", F.explode(places_in)), dims, lists.select("_lq", *q))
    low = lambda i: F.when(F.col("_lq") < coarse, F.shiftleft(f"_q{i}", area.bits) + F.col(f"_o{i}")).otherwise(F.expr(f"shiftright(_q{i}, greatest(_lq - {coarse}, 0))"))
    masks = spread_out.groupBy(*[low(i).alias(f"_c{i}") for i in dims]).agg(F.collect_set("_lq").alias("_levels"))
    asked = placed.withColumns({f"_c{i}": area.bin(f"_p{i}", i, coarse) for i in dims}).join(F.broadcast(masks), area.each("_c"))
    asked = asked.withColumn("_lq", F.explode("_levels")).withColumns({f"_q{i}": area.bin(f"_p{i}", i, F.col("_lq")) for i in dims})
    # a bin with very many points is split by the adaptive join: nothing behind it needs its rows together
    met = asked.drop(*area.each("_c"), "_levels").join(dealt(lists), ["_lq", *q])

    square = lambda x: _total((F.col(f"_p{i}") - x[f"_t{i}"]) * (F.col(f"_p{i}") - x[f"_t{i}"]) for i in dims)
    measured = F.transform("_list", lambda x: F.struct(square(x).alias("d2"), x["_t"].alias("t")))
    return met.select(*points.columns, (F.array(F.array_min(measured)) if k == 1 else F.array_sort(measured)).alias("_near"))
