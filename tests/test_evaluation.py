import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.ml import fuse, train
from emberlake.operators import firestats as FS
from emberlake.operators import metrics as M
from emberlake.operators import sampling as N
from emberlake.operators import skew


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(map(int, y), map(float, p))), "y int, p double")


def test_perfect_and_constant_scores(spark):
    perfect = M.evaluate(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert perfect.auc_roc == 1.0 and perfect.pr_auc == 1.0 and perfect.best_f1 == 1.0
    flat = M.evaluate(frame(spark, [0, 1, 0, 1], [0.5] * 4)).first()
    assert flat.auc_roc == 0.5 and flat.pr_auc == 0.5


def test_metrics_equal_definitions(spark):
    rnd = random.Random(2)
    y = [int(rnd.random() < 0.3) for _ in range(800)]
    p = [round(min(max(rnd.gauss(0.3 + 0.2 * v, 0.2), 0), 1), 2) for v in y]
    got = M.evaluate(frame(spark, y, p)).first()
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got.auc_roc == pytest.approx(auc)
    assert got.brier_score == pytest.approx(np.mean((np.array(p) - np.array(y)) ** 2))
    ap, before = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp = sum(b for a, b in zip(p, y) if a >= t)
        ap += (tp - before) / len(pos) * tp / sum(a >= t for a in p)
        before = tp
    assert got.pr_auc == pytest.approx(ap)
    edges = np.linspace(0, 1, 11)
    pa, ya = np.array(p), np.array(y)
    ece = sum(abs(pa[m].mean() - ya[m].mean()) * m.sum() / len(p) for m in ((pa >= a) & (pa < b) for a, b in zip(edges, edges[1:])) if m.any())
    assert got.ece == pytest.approx(ece)


def test_calibration_curve_keeps_empty_bins(spark):
    got = M.calibration_curve(frame(spark, [0, 1], [0.05, 1.0])).orderBy("bin").collect()
    assert len(got) == 10 and got[0]["count"] == 1 and sum(r["count"] for r in got) == 1
    assert got[4].predicted_mean == pytest.approx(0.45)


def test_zones_without_both_classes_are_left_out(spark):
    rows = [("A", 1, 0.5)] * 60 + [("B", i % 2, 0.1 * (i % 7)) for i in range(60)] + [("C", i % 2, 0.3) for i in range(10)]
    df = spark.createDataFrame(rows, "bec_zone string, y int, p double")
    assert [r.bec_zone for r in M.evaluate_zones(df).collect()] == ["B"]


def test_drift(spark):
    df = spark.createDataFrame([(0.80, 0.01), (0.90, 0.2), (0.95, 0.01)], "auc_roc double, ece double")
    got = [(r.drift_detected, len(r.alerts)) for r in M.drift_alerts(df, 0.9).orderBy("auc_roc").collect()]
    assert got == [(True, 2), (True, 1), (False, 0)]


@pytest.mark.parametrize("seed", [2, 3])
def test_running_totals_and_median(spark, seed):
    rnd = random.Random(seed)
    rows = [(z, float(rnd.choice([1, 2, 2, 2, rnd.randint(0, 90)]))) for z in "AAAAAAB" for _ in range(41)]
    df = spark.createDataFrame(rows, "z string, v double")
    for r in skew.running_totals(df, "v", {"n": F.count(F.lit(1))}, ["z"]).collect():
        mine = [v for z, v in rows if z == r.z]
        assert (r.n_before, r.n, r.n_all) == (sum(v < r.v for v in mine), mine.count(r.v), len(mine))
    got = {r.z: r.m for r in skew.group_median(df, "v", ["z"], "m").collect()}
    assert got == {z: statistics.median(v for q, v in rows if q == z) for z in "AB"}


def test_percentile_counts_strictly_smaller(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0, 3.0, 9.0, 9.0])], "cell_id string, v double")
    got = {r.cell_id: r.p for r in FS.percentile_of(df, {"v": "p"}).collect()}
    assert [got[str(i)] for i in range(8)] == [0, 0, 0, 38, 50, 50, 75, 75]


def test_tiers_and_regime_of_cells_without_fires(spark):
    cells = spark.createDataFrame([("a", 50.0, -120.0, "IDF", "C3"), ("b", 55.5, -130.0, "SBS", "C2")], "cell_id string, lat double, lon double, bec_zone string, fuel_type string")
    rows = [(1, 50.01, -120.0, 2016, 5.0, "human"), (2, 50.0, -120.0, 2015, None, "lightning"), (3, 50.0, -120.0, 1996, 7.0, "human"), (4, 50.0, -120.0, 1990, 9.0, None)]
    fires = spark.createDataFrame(rows, "fire_id int, lat double, lon double, year int, size_ha double, cause string")
    got = {r.cell_id: r for r in FS.fire_statistics(cells, fires, 2026).collect()}
    a, b = got["a"], got["b"]
    assert a.fires_10yr["count"] == 1 and a.fires_30yr["count"] == 3 and a.fires_all["count"] == 4 and a.record_start == 1990
    assert a.fires_30yr["causes"] == {"human": 2, "lightning": 1} and a.fires_10yr["nearest_km"] == pytest.approx(1.112, abs=0.01)
    assert b.fires_all["count"] == 0 and b.fires_all["causes"] == {} and b.fires_10yr["largest_ha"] is None
    assert b.typical_severity == "low" and b.dominant_cause == "unknown" and b.mean_return_years is None


def test_folds_and_samples(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    sizes = {(r.y, r.fold): r["count"] for r in N.folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()}
    assert sizes == {(y, f): 20 if y else 180 for y in (0, 1) for f in range(5)}
    first, again = (sorted(r.id for r in N.hash_sample(df.repartition(n), 123, ["id"]).collect()) for n in (1, 7))
    assert len(first) == 123 and first == again
    assert N.hash_sample(df, 5000, ["id"]).count() == 1000
    parts = {r.split: r["count"] for r in N.three_way_split(df, "y", ["id"]).groupBy("split").count().collect()}
    assert parts == {"train": 800, "validation": 100, "test": 100}


def test_negatives_stay_away_from_fires(spark):
    cells = spark.createDataFrame([(f"c{i}", 50.0 + i, -120.0) for i in range(10)], "cell_id string, lat double, lon double")
    days = spark.sql("select explode(sequence(date'2020-06-01', date'2020-07-30')) as date")
    fires = spark.createDataFrame([("c0", "2020-06-15"), ("c3", "2020-07-01")], "cell_id string, d string").select("cell_id", F.col("d").cast("date").alias("date"))
    got = N.negative_samples(fires, cells, days).collect()
    assert len(got) == 20 == len({(r.cell_id, r.date) for r in got})
    for r in got:
        for c, d in (("c0", "2020-06-15"), ("c3", "2020-07-01")):
            assert r.cell_id != c or abs((r.date - __import__("datetime").date.fromisoformat(d)).days) > 7


def test_zone_fit_equals_newton_on_all_rows(spark):
    rnd = np.random.default_rng(5)
    p = rnd.uniform(0.02, 0.98, 600).round(2)
    y = (rnd.uniform(size=600) < p**1.5).astype(int)
    rows = [("IDF", float(a), int(b)) for a, b in zip(p, y)] + [("PP", 0.4, 1)] * 20 + [("AT", 0.5, 1), ("AT", 0.4, 0)]
    got = {r.bec_zone: r for r in fuse.fit_zones(spark.createDataFrame(rows, "bec_zone string, p double, y int"), "y", "p").collect()}
    x = np.column_stack([np.log(p / (1 - p)), np.ones_like(p)])
    t = np.zeros(2)
    for _ in range(50):
        s = 1 / (1 + np.exp(-x @ t))
        ridge = np.array([1.0, 0.0])
        t -= np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) + np.diag(ridge), x.T @ (s - y) + ridge * t)
    assert (got["IDF"].xgb_weight, got["IDF"].bias) == pytest.approx(tuple(t), abs=1e-6)
    assert (got["PP"].xgb_weight, got["PP"].bias) == (1.0, 0.0) == (got["AT"].xgb_weight, got["AT"].bias)
    assert len(got) == 14


def test_fusion_bounds_and_unknown_zone(spark):
    df = spark.createDataFrame([("IDF", 0.0, 0.0), ("XX", 0.5, 0.5), (None, 1.0, 1.0)], "bec_zone string, score_a double, score_b double")
    params = fuse.parameter_frame(spark, {"IDF": (0.65, 0.35, 0.0)})
    got = [r.score for r in fuse.fuse(df, params).orderBy("score_a").collect()]
    assert 0 <= got[0] < 1e-6 and got[1] == pytest.approx(0.5) and 1 - 1e-6 < got[2] <= 1


def test_boosted_trees_learn_and_intervals_cover(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.random(), rnd.random()) for i in range(600)]
    df = spark.createDataFrame([(i, a, b, int(a + 0.3 * b > 0.8)) for i, a, b in rows], "id int, a double, b double, fire int")
    _, _, tested = train.train_and_test(df, ["a", "b"], ["id"], rounds=5, depth=3)
    assert tested.first().auc_roc > 0.9
    scored = df.select(F.lit("IDF").alias("bec_zone"), F.col("a").alias("p"), F.col("fire").cast("double").alias("y"))
    ci = train.with_interval(scored.withColumn("score", F.col("p")), train.residual_bounds(scored))
    share = ci.select(F.avg(F.col("y").between(F.col("confidence_interval.lower") - 1e-3, F.col("confidence_interval.upper") + 1e-3).cast("int"))).first()[0]
    assert share >= 0.8


def test_bounds_follow_the_features_and_never_cross(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 100 / 100.0).alias("dry"), (F.col("id") * 7919 % 1000 / 1000.0).alias("noise"), "id"
    ).withColumn("target", F.col("dry") * 0.6 + F.col("noise") * F.when(F.col("dry") < 0.5, 0.1).otherwise(0.4))
    bounds = train.train_bounds(rows, ["dry"], "target")
    got = train.quantile_bounds(bounds, rows)
    inside = F.col("target").between(F.col("lower"), F.col("upper")).cast("double")
    wet, dry = F.col("dry") < 0.4, F.col("dry") > 0.6
    width = F.col("upper") - F.col("lower")
    r = got.agg(F.count("lower").alias("n"), F.min(width).alias("least"), F.min("lower").alias("low"), F.max("upper").alias("high"), F.avg(inside).alias("share"),
                F.avg(F.when(wet, width)).alias("wet"), F.avg(F.when(dry, width)).alias("dry")).first()
    assert r.n == 4000 and r.least >= 0 and r.low >= 0 and r.high <= 1 and 0.85 <= r.share <= 0.97
    assert r.dry > 2 * r.wet  # the target spreads more where it is dry
    with pytest.raises(ValueError):
        train.train_bounds(rows, ["dry"], "target", 0.9, 0.1)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals_with_one_key_that_owns_most(spark, keys):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string").substr(-1, 1)).alias("k"), (F.col("id") * 31 % 997 / 7.0).alias("v"))
    got = {(tuple(r[c] for c in keys), r.v): (r.n, r.n_before, r.n_all) for r in skew.running_totals(df, "v", {"n": F.count(F.lit(1))}, keys).collect()}
    want, by = {}, {}
    for r in df.collect():
        by.setdefault(tuple(r[c] for c in keys), []).append(r.v)
    for key, values in by.items():
        for v in set(values):
            want[key, v] = (values.count(v), sum(x < v for x in values), len(values))
    assert got == want
