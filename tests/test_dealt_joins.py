"""Joins of tables that grow with the input are dealt by a shuffle, whatever their estimated size."""

from pyspark.sql import functions as F

from emberlake.operators.serving import locate, star_lookup
from emberlake.operators.spatial import nearest
from emberlake.operators.temporal import change_24h


def _places(spark, n, key, prefix):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit(prefix), k.cast("string")).alias(key), (F.lit(49.0) + k * 7 % 97 / 10).alias("lat"), (F.lit(-130.0) + k * 11 % 89 / 10).alias("lon")
    )


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_nearest_broadcasts_hot_keys_only(spark):
    cells = _places(spark, 300, "cell_id", "c")
    got = nearest(_places(spark, 500, "fire_id", "f"), cells, "fire_id", "cell_id")
    assert _broadcasts(got) == 2  # the list of hot bins, for each side of the salted join
    assert got.count() == 500


def test_lookup_tables_are_never_broadcast(spark):
    cells = _places(spark, 300, "cell_id", "c").withColumns({"bec_zone": F.lit("IDF"), "fuel_type": F.lit("C3"), "elevation_m": F.lit(1.0)})
    located = spark.range(50).select(F.col("id").alias("location_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("cell_id"), F.lit(None).cast("string").alias("error"))
    scores = cells.select("cell_id", F.lit(0.5).alias("score"))
    got = star_lookup(located, cells, scores, scores.select("cell_id", F.lit(1).alias("exposure")))
    assert _broadcasts(got) == 0
    assert got.where("bec_zone = 'IDF' and exposure = 1").count() == 50
    assert _broadcasts(locate(_places(spark, 40, "location_id", "l"), cells, "location_id")) == 2
    days = cells.select("cell_id", F.lit("2001-01-02").cast("date").alias("date"), F.lit(0.5).alias("score"))
    assert _broadcasts(change_24h(days)) == 0
