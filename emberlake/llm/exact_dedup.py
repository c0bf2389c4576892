"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import SPACE, salts_of
from emberlake.session import materialize


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """One row per distinct text: ``_digest``, ``_text``, ``keep_id``, ``group_size``.

    Each task first combines its own copies (partial aggregation by digest, salt and full
    text), the salted groups are merged, and only the digests that were split meet again
    in a last combination of their salt winners. All three compare the full text.
    """
    salts = F.broadcast(hot)  # bounded by hot_keys
    split = rows.join(salts, "_digest", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.col("_salts")))
    merged = split.groupBy("_digest", "_text", "_salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    whole = merged.where(F.col("_salt").isNull()).select("_digest", "_text", "keep_id", "group_size")
    winners = merged.where(F.col("_salt").isNotNull())
    return whole.union(winners.groupBy("_digest", "_text").agg(F.min("keep_id"), F.sum("group_size")))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with its group of equal texts.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.
    Texts are equal when they are identical after ``normalised``; null and empty texts form
    one group. Of a group, the row with the smallest ``doc_id`` is kept; of several rows with
    that id, one. Null ids lose against any id; a group without ids keeps one row and has a
    null ``keep_id``. Other columns of ``docs`` are not looked at. An empty table gives none.

    ``digest`` only finds candidates. Should two texts share one, all rows of that digest
    go through a join on the full text.
    """
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_text"))
    keyed = rows.withColumn("_digest", digest(F.col("_text")))
    hot = materialize(salts_of(keyed, ["_digest"]), "dedup-hot")
    # the texts move once, to be compared; what is stored and joined below are digests and ids
    groups = materialize(_combined(keyed, hot).drop("_text"), "dedup-groups")
    clashes = groups.groupBy("_digest").count().where("count > 1").select("_digest")

    sha = F.sha2(F.col("_text"), 256).alias("text_sha256")
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("_salts", F.lit(1))).alias("_salt")
    found = keyed.select("doc_id", "_digest", sha).join(F.broadcast(hot), "_digest", "left").select("doc_id", "_digest", "text_sha256", salt)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)).alias("_salt")
    offered = groups.join(F.broadcast(hot), "_digest", "left").select("_digest", "keep_id", "group_size", copies)
    if clashes.isEmpty():
        joined = found.join(offered, ["_digest", "_salt"])
    else:
        clean = found.join(clashes, "_digest", "left_anti").join(offered, ["_digest", "_salt"])
        same = keyed.join(clashes, "_digest", "left_semi")
        texts = _combined(same, hot)
        mixed = same.join(texts, ["_digest", "_text"]).withColumn("_salt", F.lit(0).cast("bigint"))
        joined = clean.unionByName(mixed.select("_digest", "_salt", "doc_id", sha, "keep_id", "group_size"))
    first = F.row_number().over(Window.partitionBy("_digest", "_salt", "doc_id", "keep_id").orderBy("text_sha256")) == 1
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    # all columns travel in one, so none can clash with those made here
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), F.sha2(normalised(F.col("text")), 256).alias("_sha"))
    joined = rows.join(kept, rows["_key"].eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("_sha", "_key").orderBy(F.lit(0)))
    return joined.withColumn("_nth", once).where("_nth = 1").select("_row.*")
