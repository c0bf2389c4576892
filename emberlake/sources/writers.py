"""Sinks (S10-S16, S20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace just the partitions present in ``df``; a rerun is idempotent.

    ``rebalance`` gathers a partition's rows for few files, yet splits one that is
    far larger than the rest.
    """
    (
        df.hint("rebalance", *by)
        .sortWithinPartitions(*by, *[c for c in ("cell_id",) if c in df.columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def existing_partitions(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(*by).distinct()
    except AnalysisException:
        return None


def write_missing_months(features: DataFrame, path: str, date: str = "date") -> None:
    """Months already written are skipped, the rest go to year/month folders."""
    dated = features.withColumns({"year": F.year(date), "month": F.month(date)})
    done = existing_partitions(features.sparkSession, path, ["year", "month"])
    if done is not None:
        dated = dated.join(F.broadcast(done), ["year", "month"], "left_anti")
    overwrite_partitions(dated, path, ["year", "month"])


def write_typed(df: DataFrame, path: str, schema) -> None:
    """The given schema in order, also when there are no rows."""
    fields = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    df.select(*fields).write.mode("overwrite").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Full replacement."""
    df.write.mode("overwrite").parquet(path)


def append_run(spark: SparkSession, path: str, row: tuple, schema) -> None:
    """One run-log row, its error cut to 1,000 characters."""
    append_runs(spark.createDataFrame([row], schema).coalesce(1), path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Run-log rows, their errors cut to 1,000 characters."""
    runs.withColumn("error", F.substring("error", 1, 1000)).write.mode("append").parquet(path)


def write_parameters(params: DataFrame, path: str) -> None:
    """Zone parameters as one JSON document (at most one row per zone)."""
    names = ["xgb_weight", "cnn_weight", "bias"]
    entry = F.struct("bec_zone", F.struct(*names))
    text = params.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)
