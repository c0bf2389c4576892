"""Joins and running totals that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.session import materialize

MOST_HOT_KEYS = 100_000
ROWS_PER_SALT = 250_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose both sides grow with the input: joined by a shuffle, never broadcast.

    Spark estimates a side by its compressed files, and a list as one entry; a table of a million
    rows can pass for a small one, and a broadcast goes through the driver.
    """
    return df.hint("merge")


def hot_keys(counts: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows and how many salts each gets; ``counts`` has ``_n`` rows per key.

    Above ``rows_per_salt * MOST_HOT_KEYS`` rows in all, the step grows with the table, so
    fewer than ``MOST_HOT_KEYS`` keys can exceed it and the result may be broadcast at any
    size. No key is left out: one below the step fits a task as it is.
    """
    total = counts.agg(F.sum("_n")).scalar()
    step = F.greatest(F.lit(rows_per_salt), F.ceil(total / MOST_HOT_KEYS))
    hot = counts.where(F.col("_n") > step)
    return hot.select(*keys, F.ceil(F.col("_n") / step).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    counts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are split over many tasks.

    Rows of ``big`` with a hot key get a salt from a hash of ``salt_on`` (which
    should tell rows of one key apart, and makes retries repeat the same salt);
    the matching rows of ``small`` are repeated once per salt. Other keys keep
    salt 0 and cost nothing extra. Keys are counted with map-side combine, or taken
    from ``counts`` (keys and ``_n``) where the caller has a cheaper source. Where few rows
    make many, name a number of ``tasks``; else small partitions are put together by their bytes.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(hot_keys(counts, keys, rows_per_salt))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salt = F.pmod(F.xxhash64(*salt_on), salts).cast("int").alias("_salt")
    left = big.join(hot, list(keys), "left").select(*big.columns, salt)
    copies = F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
    right = small.join(hot, list(keys), "left").select(*small.columns, copies)
    if tasks is not None:
        left, right = (side.repartition(tasks, *keys, "_salt") for side in (left, right))
    return left.join(dealt(right), [*keys, "_salt"], how).drop("_salt")


def running_totals(df: DataFrame, order: str, sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Totals strictly below each distinct ``order`` value, per key, exactly.

    Returns one row per (keys, order) with ``<name>``, ``<name>_before`` and
    ``<name>_all`` for every entry of ``sums``. ``keys`` must come from a
    bounded domain (zones, years).

    Rows are first combined per distinct value. The values are then dealt out by range over as
    many partitions as the session shuffles to (a sample sort), so a range has its share of the
    distinct values of all keys, whatever one key owns; what is broadcast is a row for each range
    and key in it. A window runs inside a range only.
    """
    group = [*keys]
    values = df.groupBy(*group, order).agg(*[expr.alias(name) for name, expr in sums.items()])
    # written, as the number of a range must be the same for all who read it
    dealt = values.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(dealt, "ranges")
    per_range = ranged.groupBy(*group, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    of_key = Window.partitionBy(*group) if keys else Window.partitionBy(F.lit(0))
    earlier = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = [(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_off"), F.sum(f"_{n}").over(of_key).alias(f"{n}_all")) for n in sums]
    offsets = per_range.select(*group, "_range", *[c for pair in totals for c in pair])
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), [*group, "_range"])
    return placed.select(
        *group,
        order,
        *[F.col(n) for n in sums],
        *[(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}_off")).alias(f"{n}_before") for n in sums],
        *[F.col(f"{n}_all") for n in sums],
    )


def group_median(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Exact median per key of a bounded domain, without holding a key in one task."""
    ranked = running_totals(df.where(F.col(value).isNotNull()), value, {"n": F.count(F.lit(1))}, keys)
    low, high = F.floor((F.col("n_all") - 1) / 2), F.floor(F.col("n_all") / 2)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    middle = ranked.where((first <= high) & (last >= low))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2.0).alias(name))
