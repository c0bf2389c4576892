import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlake.operators.temporal import fold_codes
from emberlake.session import fresh_path
from emberlake.streaming import moisture, state, windows
from emberlake.streaming.store import KeyedTable, run_into

DATA = "/root/testdata/sf0.001"
START = dt.datetime(2024, 2, 27)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_streams_see_all_rows_of_a_folder_of_many_files(spark, tmp_path):
    import __spark_entry__ as entry

    for name in os.listdir(DATA):
        if name != "events.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    spark.read.parquet(f"{DATA}/events.parquet").repartition(80).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("t02_lightning_24h", "t05_streamed_usage"):
        one, many = (sorted(map(tuple, entry.queries()[name](spark, folder).collect())) for folder in (DATA, str(tmp_path)))
        assert one == many and one
    assert sum(r[2] for r in one) == spark.read.parquet(f"{DATA}/events.parquet").count()


def shuffled(spark, rows, schema, files=12, per_batch=5):
    """The rows as a stream of files in no order of time, some files to a batch."""
    rows = random.Random(2).sample(rows, len(rows))
    root = fresh_path(spark, "in")
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(root)
    return windows.file_stream(spark, root, spark.createDataFrame([], schema).schema, files_per_trigger=per_batch)


def test_windows_keep_open_ends_and_late_rows(spark):
    rnd = random.Random(1)
    ticks = [(rnd.choice("abc"), START + dt.timedelta(minutes=rnd.randrange(60 * 24 * 5)), rnd.choice([1.0, 2.0, -1000.0])) for _ in range(300)]
    hourly = run_into(shuffled(spark, ticks, "cell_id string, ts timestamp, flashes double"), windows.lightning_table(fresh_path(spark, "t"), buckets=3))
    want = Counter()
    for cell, ts, n in ticks:
        hour = ts.replace(minute=0)
        for k in range(24):
            want[cell, hour - dt.timedelta(hours=k)] += max(n, 0.0)
    assert {(r.cell_id, r.window_start): r.flashes for r in windows.lightning_windows(hourly, 24).collect()} == dict(want)


def test_extremes_and_usage_equal_plain_loops(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), START + dt.timedelta(minutes=rnd.randrange(60 * 24 * 4)), rnd.uniform(270, 310), rnd.uniform(1, 99), float(rnd.randrange(5)), float(i), 0.5 * rnd.randrange(3)) for i in range(300)]
    schema = "cell_id string, ts timestamp, temperature_k double, rh_pct double, wind_ms double, wind_dir_deg double, precip_mm double"
    table = run_into(shuffled(spark, rows, schema), windows.extremes_table(fresh_path(spark, "t"), buckets=2))
    got = {(r.cell_id, r.date): tuple(r)[2:] for r in windows.daily_extremes(table).collect()}
    days = {}
    for r in rows:
        days.setdefault((r[0], r[1].date()), []).append(r)
    assert set(got) == set(days)
    for key, own in days.items():
        windiest = min(own, key=lambda r: (-r[4], r[1], -r[5]))
        want = (max(r[2] for r in own) - 273.15, min(r[3] for r in own), windiest[4] * 3.6, windiest[5], sum(r[6] for r in own))
        assert got[key] == pytest.approx(want)
    asked = [(k, START + dt.timedelta(hours=h)) for k in (1, 2, None) for h in range(100)]
    used = run_into(shuffled(spark, asked, "api_key long, ts timestamp"), windows.usage_table(fresh_path(spark, "t"), buckets=2))
    want = Counter((k, (ts - dt.timedelta(hours=8)).date()) for k, ts in asked)
    assert {(r.api_key, r.day): r.used for r in used.collect()} == dict(want)


def test_sessions_of_shuffled_batches(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), START + dt.timedelta(minutes=rnd.randrange(60 * 24 * 60)), rnd.random()) for _ in range(120)]
    rows += [("a", START + dt.timedelta(hours=25 * k), 0.5) for k in range(3)]  # exactly a gap apart: not one session
    table = run_into(shuffled(spark, rows, "cell_id string, ts timestamp, score double"), windows.sessions_table(fresh_path(spark, "t"), buckets=2))
    got = sorted((r.cell_id, r.session_start, r.session_end, r.records, r.max_score) for r in windows.risk_sessions(table).collect())
    want, gap = [], dt.timedelta(hours=25)
    for cell, ts, score in sorted(rows):
        if want and want[-1][0] == cell and ts < want[-1][2]:
            c, first, _, n, best = want.pop()
            want.append((c, first, ts + gap, n + 1, max(best, score)))
        else:
            want.append((cell, ts, ts + gap, 1, score))
    assert got == want


def test_late_days_are_folded_in(spark):
    rnd = random.Random(5)
    schema = "cell_id string, date date, temperature_c double, rh_pct double, wind_kmh double, precip_24h_mm double"
    first = dt.date(2020, 12, 20)
    rows = [(c, first + dt.timedelta(days=d), rnd.uniform(5, 30), rnd.uniform(20, 90), rnd.uniform(0, 40), rnd.choice([0.0, 0.0, 6.0])) for c in "abc" for d in range(30)]
    rows.append(("a", first + dt.timedelta(days=3), 30.0, 20.0, 30.0, 0.0))  # a second reading of a day: the mean counts
    got = run_into(shuffled(spark, rows, schema), moisture.codes_table(fresh_path(spark, "t"), buckets=2))
    daily = spark.createDataFrame(rows, schema).groupBy("cell_id", "date").agg(*[F.avg(c).alias(c) for c in moisture.DRIVERS])
    want = fold_codes(daily, reset="none")
    columns = ["cell_id", "date", "ffmc", "dmc", "dc", "fwi"]
    a, b = (sorted(map(tuple, df.select(columns).collect())) for df in (got, want))
    assert len(a) == 90 and [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x[2:] == pytest.approx(y[2:], abs=1e-9)


def test_a_batch_rewrites_only_its_buckets_and_may_be_repeated(spark):
    root = fresh_path(spark, "t")
    table = state.snapshot_table(root, ["score"], buckets=8)
    at = lambda h: START + dt.timedelta(hours=h)
    frame = lambda rows: spark.createDataFrame(rows, "cell_id string, run_ts timestamp, score double")
    cells = [f"c{i}" for i in range(40)]
    table(frame([(c, at(0), 1.0) for c in cells]), 0)
    before = table.versions(spark, 0)
    assert len(before) == 8
    for _ in range(2):  # a repeated batch changes nothing
        table(frame([("c3", at(1), 2.0), ("c3", at(-5), 9.0)]), 1)
    after = table.versions(spark, 1)
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and os.listdir(f"{root}/data/batch=1") and sum(n.startswith("bucket=") for n in os.listdir(f"{root}/data/batch=1")) == 1
    got = {r.cell_id: (r.run_ts, r.score) for r in table.read(spark).collect()}
    assert got == {c: (at(0), 1.0) for c in cells} | {"c3": (at(1), 2.0)}
    table(frame([("c3", at(47.5), 3.0), ("new", at(49), 4.0)]), 2)
    assert not os.path.exists(f"{root}/data/batch=0/bucket={changed[0]}")  # replaced two batches ago
    assert sorted(r.cell_id for r in state.live(table.read(spark)).collect()) == ["c3", "new"]
    again = KeyedTable(root, ["cell_id"], table.partial, table.merge, 8)  # a later run goes on from the files
    again(frame([("c4", at(50), 5.0)]), 3)
    assert again.read(spark).count() == 41


def test_streamed_alerts_equal_a_plain_loop(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, 3, None]), START + dt.timedelta(minutes=7 * (i // 2)), rnd.random()) for i in range(1500)]
    root = fresh_path(spark, "alerts")
    whole = spark.createDataFrame(rows, "alert_id bigint, ts timestamp, score double").withColumn("threshold", F.lit(0.7))
    for lo in (0, 500, 1000):
        part = spark.createDataFrame(rows[lo : lo + 500], "alert_id bigint, ts timestamp, score double").withColumn("threshold", F.lit(0.7))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = windows.file_stream(spark, f"{root}/in", whole.schema, files_per_trigger=1)
    got = sorted((r.alert_id, r.ts) for r in state.run_alerts(stream, f"{root}/work").collect())
    want, last = [], {}
    for a, ts, s in rows:
        if a is not None and s >= 0.7 and (a not in last or ts - last[a] >= dt.timedelta(hours=24)):
            want.append((a, ts))
            last[a] = ts
    assert got == sorted(want)


def test_a_hot_alert_is_read_once_in_order(spark):
    hot = spark.range(1_000_000).select(F.lit(2**60 + 1).alias("alert_id"), (F.col("id") * 7919 % 1_000_000 * 1_000_000).alias("us"), F.lit(0.9).alias("score"))
    got = sorted((r.alert_id, r.us) for r in state.firings(hot).collect())
    assert got == [(2**60 + 1, k * 86_400 * 1_000_000) for k in range(12)]
