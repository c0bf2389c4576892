"""Results of a stream kept as a keyed table: every batch is merged in, so nothing is late and nothing stays open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.session import remove


class KeyedTable:
    """foreachBatch upkeep of a table of partial results that can be merged (sums, extremes, sessions, histories).

    ``partial`` combines the rows of a batch per key before they are shuffled far; ``merge`` brings
    stored rows (of the table's columns) and new ones together. Rows lie in buckets by a hash of
    ``keys``, below ``period`` (a text column, e.g. the month) if results of one period never
    meet those of another. A batch reads and replaces only the buckets it touches:
    ``<root>/data/batch=<id>/bucket=<name>`` holds what batch ``id`` wrote, and
    ``<root>/current/<id>`` says which batch's files each bucket has now. The pointer comes
    last and a batch reads only the one before its own, so a repeated or broken batch does
    no harm. Replaced files are removed one batch later.

    If ``placed``, ``partial`` combines nothing, so a batch is read in place, and ``merge`` leaves the rows dealt out by
    their key, so they are written where they lie. ``view`` adds to the stored columns what follows from them.

    As merging doesn't depend on the order of batches, rows may come in any order and in any
    number of files. Only names of touched buckets reach the driver, at most ``buckets`` a period.
    """

    def __init__(
        self,
        root: str,
        keys: list[str],
        partial: Callable[[DataFrame], DataFrame],
        merge: Callable[[DataFrame, DataFrame], DataFrame],
        buckets: int = 16,
        period: Column | None = None,
        placed: bool = False,
        view: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.root, self.keys, self.partial, self.merge, self.buckets, self.period = root, keys, partial, merge, buckets, period
        self.placed, self.view = placed, view
        self.last: int | None = None
        self.schema = None

    def _bucket(self) -> Column:
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        # a letter in front keeps the name from being read as a date or number
        return F.concat(F.lit("b"), *([self.period, F.lit("-")] if self.period is not None else []), place)

    def prepare(self, rows: DataFrame) -> None:
        """Learn the table's columns from rows like those of the stream."""
        if self.schema is None:
            new = self.partial(rows.sparkSession.createDataFrame([], rows.schema))
            self.schema = self.merge(None, new).schema

    def versions(self, spark: SparkSession, batch_id: int) -> dict[str, int]:
        """Which batch wrote each bucket, after batch ``batch_id``."""
        if batch_id < 0:
            return {}
        return {r.bucket: r.batch for r in spark.read.schema("bucket string, batch long").parquet(f"{self.root}/current/{batch_id}").collect()}

    def _rows(self, spark: SparkSession, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[self._path(v, b) for b, v in sorted(versions.items())])

    def _path(self, batch_id: int, bucket: str) -> str:
        return f"{self.root}/data/batch={batch_id}/bucket={bucket}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.prepare(batch)
        incoming = f"{self.root}/incoming/{batch_id}"
        new = self.partial(batch).withColumn("_bucket", self._bucket())
        if not self.placed:
            new.write.mode("overwrite").parquet(incoming)
            new = spark.read.schema(new.schema).parquet(incoming)
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}
        before = self.versions(spark, batch_id - 1)
        merged = self.merge(self._rows(spark, {b: v for b, v in before.items() if b in touched}), new.drop("_bucket"))
        out = f"{self.root}/data/batch={batch_id}"
        placed = merged.select(*self.schema.names).withColumn("bucket", self._bucket())
        # buckets are few, so a large one is dealt to several tasks
        placed = placed if self.placed else placed.hint("rebalance", "bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("bucket").parquet(out)
        written = spark.read.schema(placed.schema).parquet(out).select("bucket").distinct().collect()
        now = {b: v for b, v in before.items() if b not in touched} | {r[0]: batch_id for r in written}
        pointer = spark.createDataFrame(sorted(now.items()), "bucket string, batch long").coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{self.root}/current/{batch_id}")
        for bucket, version in self.versions(spark, batch_id - 2).items():  # what the batch before this one replaced
            if before.get(bucket) != version:
                remove(spark, self._path(version, bucket))
        if batch_id:
            remove(spark, f"{self.root}/incoming/{batch_id - 1}")
        self.last = batch_id

    def read(self, spark: SparkSession) -> DataFrame:
        """The table after the last batch of this run."""
        rows = self._rows(spark, self.versions(spark, -1 if self.last is None else self.last))
        return self.view(rows) if self.view else rows


def run_into(stream: DataFrame, table: KeyedTable) -> DataFrame:
    """Merge what is there into ``table`` and return it whole."""
    table.prepare(stream)
    query = stream.writeStream.foreachBatch(table).option("checkpointLocation", f"{table.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read(stream.sparkSession)
