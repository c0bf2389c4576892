"""A bucket of a keyed table is no task: a large one is written by several."""

import glob

from pyspark.sql import functions as F

from emberlake.streaming.store import KeyedTable


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        rows = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("key"), F.rand(1).alias("x"))
        table = KeyedTable(str(tmp_path), ["key"], lambda r: r, lambda old, new: new if old is None else old.unionByName(new), buckets=1)
        table(rows, 0)
        table(rows.withColumn("key", F.col("key") + 40_000), 1)
    finally:
        spark.conf.set(name, before)
    assert len(glob.glob(f"{tmp_path}/data/batch=1/bucket=b0/*.parquet")) > 1
    assert table.read(spark).agg(F.count_distinct("key")).first()[0] == 80_000
