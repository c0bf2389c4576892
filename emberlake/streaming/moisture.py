"""Moisture codes carried across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.fwi import spread_columns
from emberlake.operators.temporal import DRIVERS, STATE, fold_codes
from emberlake.streaming.store import KeyedTable


COLUMNS = ["cell_id", "date", "n", *DRIVERS]


def _rolled_on(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Fold the new days in; of a cell with a late day all days from there on are folded again, from the codes before it.

    Stored and new days meet in one exchange on the cell. What follows (the first new day of a cell, the codes before
    it, the means of its days, the fold) is worked out where that brought them.
    """
    codes = F.struct(*STATE)
    if old is None:
        return _folded(new.select(*COLUMNS, F.lit(None).cast("struct<ffmc:double,dmc:double,dc:double>").alias("_start")).repartition("cell_id"))
    stored = old.select(*COLUMNS, codes.alias("_codes"), F.lit(False).alias("_new"))
    both = stored.unionByName(new.select(*COLUMNS, F.lit(None).cast(stored.schema["_codes"].dataType).alias("_codes"), F.lit(True).alias("_new")))
    cell = Window.partitionBy("cell_id")
    first = F.when(F.col("cell_id").isNotNull(), F.min(F.when(F.col("_new"), F.col("date"))).over(cell))
    marked = both.repartition("cell_id").withColumn("_since", first)
    kept = ~F.col("_new") & (F.col("_since").isNull() | F.coalesce(F.col("date") < F.col("_since"), F.lit(False)))
    before = F.when(kept & F.col("_since").isNotNull(), F.col("date"))
    seeded = marked.withColumn("_kept", kept).withColumn("_start", F.max_by("_codes", before).over(cell))
    return seeded.where("_kept").select(*COLUMNS, "_codes.*").unionByName(_folded(seeded.where("NOT _kept")))


def _folded(rows: DataFrame) -> DataFrame:
    """The codes of the days, means of their ``n`` readings, of rows that lie with their cell and have its first codes in ``_start``."""
    mean = [(F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c) for c in DRIVERS]
    days = rows.groupBy("cell_id", "date").agg(F.sum("n").alias("n"), *mean, F.first("_start").alias("_start"))
    return fold_codes(days, reset="none", carry=["n"], start="_start", placed=True).select(*COLUMNS, *STATE)


def codes_table(root: str, buckets: int = 16) -> KeyedTable:
    """The codes of every cell and day so far, for weather (``cell_id``, ``date``, drivers) in any order.

    A batch in the order of time only appends days to its cells; a late day changes those
    after it. Readings of one cell and day are averaged, whichever batches bring them. The
    indices that follow from a day's codes are worked out as the table is read.
    """
    readings = lambda rows: rows.select("cell_id", "date", *DRIVERS, F.lit(1).cast("long").alias("n"))
    return KeyedTable(root, ["cell_id"], readings, _rolled_on, buckets, placed=True, view=spread_columns)
