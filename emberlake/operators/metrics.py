"""Model quality from one histogram of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.constants import EVAL_THRESHOLDS, F1_THRESHOLDS
from emberlake.operators.skew import running_totals

BIN_EDGES = [i * 0.1 for i in range(10)] + [1.0]
AUC_FLOOR, ECE_CEILING, AUC_DROP = 0.85, 0.05, 0.95
METRICS = ["auc_roc", "pr_auc", "brier_score", "ece", "best_f1"]


def score_bin(p: Column) -> Column:
    """Bin 0..9 of [a, b); p = 1.0 and values outside belong to none."""
    index = F.lit(-1)
    for edge in BIN_EDGES:
        index = index + F.when(p >= edge, 1).otherwise(0)
    return F.when((index >= 0) & (index < 10), index)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2.0 * tp / F.nullif(2.0 * tp + fp + fn, F.lit(0.0))).otherwise(0.0)


def score_histogram(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, with the totals below it."""
    y = F.col(label).cast("bigint")
    slim = df.select(*keys, F.col(score).alias("p"), y.alias("_y")).where(F.col("p").isNotNull())
    return running_totals(slim, "p", {"pos": F.sum("_y"), "neg": F.sum(1 - F.col("_y"))}, keys)


def evaluate(df: DataFrame, label: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """A14-A20 per key of a bounded domain (or one row without keys).

    All metrics are sums over the histogram of distinct scores. Ranks use ties at
    their middle; average precision steps over distinct scores from the top.
    """
    group = list(keys) or ["_one"]
    hist = score_histogram(df, label, score, keys)
    if not keys:
        hist = hist.withColumn("_one", F.lit(0))
    pos, neg, p = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("p")
    above_pos = (F.col("pos_all") - F.col("pos_before")).cast("double")
    above_neg = (F.col("neg_all") - F.col("neg_before")).cast("double")
    bounded = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    sums = [
        F.sum(pos * (F.col("neg_before") + neg / 2.0)).alias("_area"),
        F.sum(pos * above_pos / (above_pos + above_neg)).alias("_ap"),
        F.sum(pos * (p - 1.0) * (p - 1.0) + neg * p * p).alias("_sq"),
        F.sum(-(pos * F.log(bounded) + neg * F.log(1.0 - bounded))).alias("_ll"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    ]
    cuts = {f"f{i}": t for i, t in enumerate(F1_THRESHOLDS)} | {f"e{i}": t for i, t in enumerate(EVAL_THRESHOLDS)}
    for name, t in cuts.items():
        sums += [
            F.sum(F.when(p >= t, F.col("pos")).otherwise(0)).alias(f"_tp_{name}"),
            F.sum(F.when(p >= t, F.col("neg")).otherwise(0)).alias(f"_fp_{name}"),
        ]
    # once per bin, then over the bins: the gap of each bin and all other sums in one pass
    sums.append(F.sum(p * (pos + neg)).alias("_ps"))
    names = [f"_{n}" for n in ("area", "ap", "sq", "ll", "pos", "neg")] + [f"_{k}_{c}" for c in cuts for k in ("tp", "fp")]
    per_bin = hist.withColumn("_bin", score_bin(p)).groupBy(*group, "_bin").agg(*sums)
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_ps") - F.col("_pos")))
    total = per_bin.groupBy(*group).agg(F.sum(gap).alias("_gap"), *[F.sum(c).alias(c) for c in names])
    n = F.col("_pos") + F.col("_neg")
    mixed = F.nullif(F.col("_pos") * F.col("_neg").cast("double"), F.lit(0.0))

    def counts(name: str) -> tuple[Column, Column, Column]:
        tp, fp = F.col(f"_tp_{name}").cast("double"), F.col(f"_fp_{name}").cast("double")
        return tp, fp, F.col("_pos") - tp

    tried = F.array(*[F.struct(_f1(*counts(f"f{i}")).alias("f1"), F.lit(-t).alias("nt")) for i, t in enumerate(F1_THRESHOLDS)])
    best = F.array_max(tried)
    by_threshold = []
    for i, t in enumerate(EVAL_THRESHOLDS):
        tp, fp, fn = counts(f"e{i}")
        by_threshold.append(
            F.struct(
                F.lit(t).alias("threshold"),
                tp.cast("bigint").alias("tp"),
                fp.cast("bigint").alias("fp"),
                fn.cast("bigint").alias("fn"),
                (F.col("_neg") - fp).cast("bigint").alias("tn"),
                F.coalesce(tp / F.nullif(tp + fp, F.lit(0.0)), F.lit(0.0)).alias("precision"),
                F.coalesce(tp / F.nullif(tp + fn, F.lit(0.0)), F.lit(0.0)).alias("recall"),
                _f1(tp, fp, fn).alias("f1"),
            )
        )
    return total.select(
        *keys,
        (F.col("_area") / mixed).alias("auc_roc"),
        (F.col("_ap") / F.nullif(F.col("_pos").cast("double"), F.lit(0.0))).alias("pr_auc"),
        (F.col("_sq") / n).alias("brier_score"),
        (F.col("_ll") / n).alias("log_loss"),
        (F.coalesce("_gap", F.lit(0.0)) / n).alias("ece"),
        best["f1"].alias("best_f1"),
        F.when(best["f1"] > 0, F.round(-best["nt"], 2)).otherwise(0.5).alias("best_threshold"),
        n.alias("n_samples"),
        F.col("_pos").alias("n_positive"),
        (F.col("_pos") / n).alias("prevalence"),
        F.array(*by_threshold).alias("thresholds"),
    )


def calibration_curve(df: DataFrame, label: str = "y", score: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction, observed fraction and count per bin; empty bins stay."""
    spark = df.sparkSession
    got = (
        df.withColumn("bin", score_bin(F.col(score)))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.avg(score).alias("_mean"), F.avg(F.col(label).cast("double")).alias("_frac"), F.count(F.lit(1)).alias("_n"))
    )
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(got), "bin", "left").select(
        "bin",
        F.coalesce("_mean", (F.col("bin") + 0.5) / float(bins)).alias("predicted_mean"),
        F.coalesce("_frac", F.lit(0.0)).alias("actual_fraction"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def evaluate_zones(df: DataFrame, label: str = "y", score: str = "p", zone: str = "bec_zone", min_samples: int = 50) -> DataFrame:
    """Zones with enough samples and both classes."""
    per_zone = evaluate(df, label, score, [zone])
    return per_zone.where(
        (F.col("n_samples") >= min_samples) & (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_samples"))
    )


def compare_scores(df: DataFrame, a: str, b: str, label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Metric deltas b - a (4 places) and which of them improved, per common key."""
    left = evaluate(df, label, a, keys)
    right = evaluate(df, label, b, keys)
    group = list(keys) or ["_one"]
    if not keys:
        left, right = left.withColumn("_one", F.lit(0)), right.withColumn("_one", F.lit(0))
    joined = left.select(*group, *[F.round(m, 4).alias(f"{m}_a") for m in METRICS]).join(
        right.select(*group, *[F.round(m, 4).alias(f"{m}_b") for m in METRICS]), group
    )
    deltas = joined.select(*keys, *[F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 4).alias(f"delta_{m}") for m in METRICS])
    return deltas.withColumns(
        {
            "auc_roc_improved": F.col("delta_auc_roc") > 0,
            "brier_improved": F.col("delta_brier_score") < 0,
            "ece_improved": F.col("delta_ece") < 0,
        }
    )


def backtest_report(per_year: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each metric over the years."""
    values = [
        expr
        for m in METRICS
        for expr in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))
    ]
    return per_year.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("years"), *values, F.sum("n_samples").alias("n_samples"), F.sum("n_positive").alias("n_positive")
    )


def drift_alerts(current: DataFrame, baseline_auc: Column | float | None = None) -> DataFrame:
    """The list of broken limits and whether there is any."""
    base = F.lit(baseline_auc) if isinstance(baseline_auc, float) else baseline_auc
    checks = [
        F.when(F.col("auc_roc") < AUC_FLOOR, F.lit("auc_below_threshold")),
        F.when(F.col("ece") > ECE_CEILING, F.lit("calibration_error_above_threshold")),
    ]
    if base is not None:
        checks.append(F.when((base > 0) & (F.col("auc_roc") < base * AUC_DROP), F.lit("auc_dropped_from_baseline")))
    alerts = F.array_compact(F.array(*checks))
    return current.withColumn("alerts", alerts).withColumn("drift_detected", F.size("alerts") > 0)


def observed_labels(predictions: DataFrame, fire_days: DataFrame) -> DataFrame:
    """Predictions with 1 where a fire was seen that day in that cell."""
    seen = fire_days.select("cell_id", "date").distinct().withColumn("_seen", F.lit(1))
    return predictions.join(seen, ["cell_id", "date"], "left").withColumn("y", F.coalesce("_seen", F.lit(0))).drop("_seen")


def season_hits(fire_days: DataFrame, predictions: DataFrame, cut: float = 0.3) -> DataFrame:
    """Share of (cell, day) fires whose prediction that day was above the cut."""
    hit = fire_days.select("cell_id", "date").distinct().join(predictions.select("cell_id", "date", "score"), ["cell_id", "date"], "left")
    flag = F.coalesce(F.col("score") > cut, F.lit(False)).cast("int")
    return hit.agg(
        F.count(F.lit(1)).alias("fire_days"),
        F.coalesce(F.sum(flag), F.lit(0)).alias("hits"),
        F.coalesce(F.round(F.avg(flag), 3), F.lit(0.0)).alias("hit_rate"),
    )
