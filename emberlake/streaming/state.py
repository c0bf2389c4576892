"""Keyed state: alert cooldowns and latest snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.constants import ALERT_COOLDOWN_HOURS
from emberlake.session import by_value
from emberlake.streaming.store import KeyedTable, run_into

by_value(__name__)

_COOLDOWN_US = ALERT_COOLDOWN_HOURS * 3_600_000_000
_OUT = pa.schema([("alert_id", pa.int64()), ("us", pa.int64()), ("score", pa.float64())])


def _cool_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exceedances by alert and time (``alert_id, us, score, fired``) -> the firings among them.

    The rows of an alert pass by in order; only the time of its last firing is remembered, and
    the search jumps from firing to firing. A row ``fired`` is one of an earlier batch.
    """
    alert, last = None, None
    for batch in batches:
        ids, us, score = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fired = batch.column(3).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
        hits = []
        for begin, end in zip(edges, [*edges[1:], len(ids)], strict=True):
            if ids[begin] != alert:
                alert, last = ids[begin], None
            at = begin
            if fired[begin]:
                last, at = us[begin], begin + 1
            while True:
                at = at if last is None else max(at, begin + int(np.searchsorted(us[begin:end], last + _COOLDOWN_US)))
                if at >= end:
                    break
                hits.append(at)
                last = us[at]
        yield pa.RecordBatch.from_arrays([pa.array(x[hits]) for x in (ids, us, score)], schema=_OUT)


def firings(exceeded: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """``alert_id, us, score`` of the first exceedance of each alert and the next ones at least a cooldown apart.

    ``exceeded`` has ``alert_id, us, score`` (rows without id or time are left out), ``last`` the last firing of alerts before it
    (``alert_id, us``). Of rows at one time the least score counts. A task sorts its alerts
    by time (spilling if need be) and reads them once, so an alert of any size takes bounded memory.
    """
    known = exceeded.where(F.col("alert_id").isNotNull() & F.col("us").isNotNull())
    rows = known.groupBy("alert_id", "us").agg(F.min("score").alias("score")).withColumn("fired", F.lit(False))
    if last is not None:
        rows = rows.unionByName(last.select("alert_id", "us", F.lit(0.0).alias("score"), F.lit(True).alias("fired")))
    order = rows.repartition("alert_id").sortWithinPartitions("alert_id", F.desc("fired"), "us")
    return order.mapInArrow(_cool_down, "alert_id long, us long, score double")


class AlertStream:
    """foreachBatch writer of firings; the last firing of each alert is kept in a keyed table.

    Batches come in the order of time, rows of a batch in any. A repeated batch reads the
    state of the one before it and writes the same files.
    """

    def __init__(self, root: str, buckets: int = 16):
        self.root = root

        def newest(rows: DataFrame) -> DataFrame:
            return rows.groupBy("alert_id").agg(F.max("us").alias("us"))

        self.table = KeyedTable(f"{root}/last", ["alert_id"], newest, lambda old, new: newest(new if old is None else old.unionByName(new)), buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        over = batch.where(F.col("score") >= F.col("threshold")).select("alert_id", F.unix_micros("ts").alias("us"), "score")
        self.table.prepare(over)
        before = self.table._rows(spark, self.table.versions(spark, batch_id - 1))
        out = f"{self.root}/fired/batch={batch_id}"
        firings(over, before.join(over.select("alert_id").distinct(), "alert_id", "left_semi")).write.mode("overwrite").parquet(out)
        self.table(spark.read.schema("alert_id long, us long, score double").parquet(out), batch_id)


def run_alerts(readings: DataFrame, root: str) -> DataFrame:
    """Firings (``alert_id, ts, score``) of the readings (``alert_id, ts, score, threshold``) that are there."""
    keeper = AlertStream(root)
    query = readings.writeStream.foreachBatch(keeper).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = readings.sparkSession
    if keeper.table.last is None:  # no rows ever came
        rows = spark.createDataFrame([], "alert_id long, us long, score double")
    else:
        rows = spark.read.schema("alert_id long, us long, score double").parquet(f"{root}/fired")
    return rows.select("alert_id", F.timestamp_micros("us").alias("ts"), "score")


def snapshot_table(root: str, values: Sequence[str], key: str = "cell_id", run: str = "run_ts", buckets: int = 16) -> KeyedTable:
    """The newest record per cell; a batch rewrites the buckets of its cells only."""
    names = [key, run, *values]

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(run, *values), F.struct(run, *values)).alias("_l")).select(key, "_l.*")

    return KeyedTable(root, [key], lambda rows: newest(rows.select(*names)), lambda old, new: newest(new if old is None else old.unionByName(new)), buckets)


def live(snapshot: DataFrame, run: str = "run_ts", hours: int = 48) -> DataFrame:
    """Records less than ``hours`` older than the newest of all."""
    return snapshot.where(F.col(run) > snapshot.agg(F.max(run)).scalar() - F.expr(f"INTERVAL {hours} HOURS"))


def run_snapshot(stream: DataFrame, root: str, values: Sequence[str]) -> DataFrame:
    """Run over what is there and return the live records."""
    return live(run_into(stream, snapshot_table(root, values)))
