"""Windows of lightning are listed beside their ticks, neither moved nor grouped."""

import random

from pyspark.sql import functions as F

from emberlake.streaming.windows import lightning_windows


def test_windows_are_listed_in_place_and_right(spark):
    dice = random.Random(3)
    hours = {(cell, hour) for cell in ("a", "b", None) for hour in dice.sample(range(-40, 200), 25)} | {("lone", 5)}
    ticks = [(cell, hour, dice.choice([None, 0.0, 1.0, 2.5])) for cell, hour in sorted(hours, key=str)]
    table = spark.createDataFrame(ticks, "cell_id string, h long, flashes double").select("cell_id", F.timestamp_seconds(F.col("h") * 3600).alias("hour"), "flashes")
    table = table.unionByName(spark.createDataFrame([("a", None, 9.0)], table.schema))
    for length in (1, 24, 72):
        want = {}
        for cell, hour, flashes in ticks:
            for start in range(hour - length + 1, hour + 1):
                want.setdefault((cell, start, start + length), []).append(flashes)
        want = {key: sum(known) if (known := [f for f in fs if f is not None]) else None for key, fs in want.items()}
        windows = lightning_windows(table, length)
        rows = windows.select("cell_id", F.unix_seconds("window_start") / 3600, F.unix_seconds("window_end") / 3600, "flashes").collect()
        assert len(rows) == len(want) and {(c, int(a), int(b)): f for c, a, b, f in rows} == want
        plan = windows._jdf.queryExecution().sparkPlan().toString()
        assert "Aggregate" not in plan
