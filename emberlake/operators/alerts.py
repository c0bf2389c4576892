"""Alert requests, state steps and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.constants import ALERT_COOLDOWN_HOURS, ALERT_MAX_FAILURES, ALERT_STALE_DAYS, ALERTS_PER_KEY
from emberlake.functions.score import danger_color, danger_level

# Host names, address ranges and suffixes that are not allowed.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "[::1]", ""]
PRIVATE_IPV4 = (
    r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(4[0-9]|5[0-5])\.)"
)
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
PRIVATE_IPV6 = r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$"
INTERNAL_SUFFIX = r"\.(local|internal|corp|lan)$"


def request_error(url: Column, threshold: Column) -> Column:
    """Null for a valid request, else the reason."""
    scheme = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit(""))
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    return (
        F.when(threshold.isNull() | ~threshold.between(0.0, 1.0), F.lit("threshold must be in [0, 1]"))
        .when(url.isNull() | (F.length(url) > 500), F.lit("url too long"))
        .when(scheme != "https", F.lit("must use https"))
        .when(host.isin(LOCAL_HOSTS), F.lit("must not target localhost"))
        .when((host.rlike(IPV4) & host.rlike(PRIVATE_IPV4)) | host.rlike(PRIVATE_IPV6), F.lit("must not target private addresses"))
        .when(host.rlike(INTERNAL_SUFFIX), F.lit("must not target internal domains"))
    )


def accept_requests(requests: DataFrame, alerts: DataFrame, cap: int = ALERTS_PER_KEY) -> DataFrame:
    """Requests that are no duplicate of an active alert and fit under the key's cap.

    Only the first ``cap`` rows of a key can ever be accepted; stating that as
    ``rank <= cap`` lets Spark keep just those on the map side, so a key with a
    third of the requests costs no more than another.
    """
    same = ["api_key", "cell_id", "threshold", "webhook_url"]
    active = alerts.where("is_active")
    fresh = requests.join(active.select(*same).distinct(), same, "left_anti")
    first = fresh.groupBy(*same).agg(F.min("request_id").alias("request_id"))
    order = Window.partitionBy("api_key").orderBy("request_id")
    ranked = first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap)
    held = active.groupBy("api_key").agg(F.count(F.lit(1)).alias("_held"))
    fitting = ranked.join(held, "api_key", "left").where(F.col("_rank") + F.coalesce("_held", F.lit(0)) <= cap)
    return fitting.select("request_id", *same)


def due_alerts(alerts: DataFrame, active_keys: DataFrame, predictions: DataFrame, now: Column, hours: int = ALERT_COOLDOWN_HOURS) -> DataFrame:
    """Active alerts of active keys whose cell reached the threshold outside the cooldown."""
    live = alerts.where("is_active").join(active_keys.select("api_key"), "api_key", "left_semi")
    met = live.join(predictions.select("cell_id", "score"), "cell_id").where(F.col("score") >= F.col("threshold"))
    waited = F.col("last_triggered").isNull() | (now - F.col("last_triggered") >= F.expr(f"INTERVAL {hours} HOURS"))
    level = danger_level(F.col("score"))
    return met.where(waited).withColumns({"level": level, "color": danger_color(level), "triggered_at": now})


def payloads(due: DataFrame) -> DataFrame:
    """The message of each due alert; delivery itself is another system's work."""
    body = F.struct(
        "alert_id", "cell_id", "threshold", F.struct(F.bround("score", 4).alias("score"), "level", "color").alias("risk"), "triggered_at"
    )
    return due.select("alert_id", "webhook_url", F.to_json(body).alias("payload"))


def alert_step(alerts: DataFrame, due: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New alert state after delivery; ``outcomes`` has alert_id and delivered.

    Success resets the failures and starts the cooldown; the fifth failure in a
    row disables the alert.
    """
    fired = due.select("alert_id", "triggered_at").join(outcomes.select("alert_id", "delivered"), "alert_id", "left")
    joined = alerts.join(fired, "alert_id", "left")
    tried, good = F.col("triggered_at").isNotNull(), F.coalesce("delivered", F.lit(False))
    fails = F.when(tried & good, 0).when(tried, F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(F.col("consecutive_failures"))
    off = tried & ~good & (fails >= ALERT_MAX_FAILURES)
    reason = F.lit(f"Auto-disabled after {ALERT_MAX_FAILURES} consecutive webhook failures")
    return joined.withColumns(
        {
            "last_triggered": F.when(tried & good, F.col("triggered_at")).otherwise(F.col("last_triggered")),
            "consecutive_failures": fails.cast("int"),
            "is_active": F.col("is_active") & ~off,
            "disabled_reason": F.when(off, reason).otherwise(F.col("disabled_reason")),
        }
    ).drop("triggered_at", "delivered")


def disable_stale(alerts: DataFrame, now: Column, days: int = ALERT_STALE_DAYS) -> DataFrame:
    """Active alerts created and last fired (if ever) before the cutoff."""
    cutoff = now - F.expr(f"INTERVAL {days} DAYS")
    stale = (
        F.col("is_active")
        & (F.col("created_at") < cutoff)
        & (F.col("last_triggered").isNull() | (F.col("last_triggered") < cutoff))
    )
    return alerts.withColumns(
        {
            "disabled_reason": F.when(stale, F.lit(f"Auto-disabled: no successful delivery in {days} days")).otherwise(F.col("disabled_reason")),
            "is_active": F.col("is_active") & ~stale,
        }
    )


def retain(df: DataFrame, date: str, today: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; on a date-partitioned table this prunes files."""
    return df.where(F.col(date) >= F.date_sub(today, days))
