"""Crawl archives: not-modified answers get back what they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import ROWS_PER_SALT, attach
from emberlake.llm.url_alias import node_of, plain_of
from emberlake.operators.skew import hot_keys

#: Fields of a not-modified answer that don't replace the stored ones: they describe the message or its missing body.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade"]
#: Fields in which a client asks whether a page has changed, and those that answer.
VALIDATORS = {"etag": "if-none-match", "last-modified": "if-modified-since"}


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ by case the last stands; null is empty."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])),
    )


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, replaced or joined by those of the not-modified answer that it may set."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def url_key(url: Column) -> Column:
    return plain_of(node_of(url))


def resolve(records: DataFrame) -> DataFrame:
    """Find, for each not-modified record, the latest earlier full response of its canonical url.

    ``records``: ``record_id, url, at, status, headers, payload``. Returns one row per record:
    ``record_id, url_key, at, outcome, response_id, payload_sha256, headers``. ``outcome`` is

    * ``full``: a response with a body (status 200); it stands for itself;
    * ``resolved``: status 304, and the response found has the same validators;
    * ``changed``: there is an earlier response, but its validator differs;
    * ``orphan``: there is no earlier response; or the url is null;
    * ``other``: any other status, null too.

    Validators: a strong or weak entity tag if both have one (weak comparison), else the
    modification dates if both have one; without any to compare, a record is resolved.
    Of records with the same time, those with smaller ids are earlier; a null time is the
    earliest. Null headers are empty, a null payload is an empty one. Repeated rows are
    each answered. Other columns are not looked at. An empty table gives none.

    A url with many records is cut into time ranges; the last response of each range is
    carried into the next ones, so no task holds all records of a url. Only digests and
    headers move here; ``hydrate`` brings the bodies.
    """
    url = F.col("url")
    rows = records.select(
        "record_id", F.coalesce(url_key(url), F.concat(F.lit("\x00"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).alias("url_key"),
        "at", "status", lower_keys(F.col("headers")).alias("headers"), F.sha2(F.coalesce(F.col("payload"), F.lit("")), 256).alias("_sha"),
    )
    counts = rows.groupBy("url_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, ["url_key"], ROWS_PER_SALT)
    # as many cuts as a busy url has ranges; together no more than hot_keys bounds
    spread = rows.select("url_key", "at").join(F.broadcast(hot), "url_key")
    quantiles = spread.groupBy("url_key", "_salts").agg(F.percentile_approx("at", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 10_000).alias("_cuts"))
    some = F.filter("_cuts", lambda c, i: (i + 1) % F.greatest(F.lit(1), F.floor(F.lit(64) / F.col("_salts"))) == 0)
    cuts = quantiles.select("url_key", some.alias("_cuts"))
    ranged = rows.join(F.broadcast(cuts), "url_key", "left")
    ranged = ranged.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("at"))), F.lit(0))).drop("_cuts")

    body = F.when(F.col("status") == 200, F.struct("record_id", "headers", "_sha"))
    order = F.struct("at", "record_id")
    last = ranged.where("status = 200").groupBy("url_key", "_range").agg(F.max_by(F.struct("record_id", "headers", "_sha"), order).alias("_last"))
    inside = Window.partitionBy("url_key", "_range").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("_near", F.last(body, ignorenulls=True).over(inside))
    ranges = ranged.select("url_key", "_range").distinct().join(last, ["url_key", "_range"], "left")
    earlier = Window.partitionBy("url_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("url_key", "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_far")).where("_far is not null")
    found = near.join(carried, ["url_key", "_range"], "left").withColumn("_hit", F.coalesce("_near", "_far")).drop("_near", "_far", "_last")

    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("_hit.headers")
    same = F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"], F.lit(True))
    outcome = (
        F.when(F.col("status") == 200, "full")
        .when(F.coalesce(F.col("status") != 304, F.lit(True)), "other")
        .when(F.col("_hit").isNull(), "orphan")
        .when(same, "resolved")
        .otherwise("changed")
    )
    out = found.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "url_key", "at", "outcome", F.when(done, F.col("_hit.record_id")).when(F.col("outcome") == "full", F.col("record_id")).alias("response_id"),
        F.when(done, F.col("_hit._sha")).when(F.col("outcome") == "full", F.col("_sha")).alias("payload_sha256"),
        F.when(done, merged_headers(theirs, mine)).otherwise(mine).alias("headers"),
    )


def hydrate(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The full and resolved rows of ``resolve`` with the body they stand for (``payload``); ids must be unique."""
    bodies = records.where("status = 200").select(F.col("record_id").alias("response_id"), "payload")
    return attach(resolved.where("response_id is not null"), bodies, ["response_id"], ["record_id"])


def header_text(headers: Column) -> Column:
    """Headers as ``name: value`` lines in order of the name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl over ``pages`` (``page_id``, ``url``, ``html``): every page is fetched, and asked for again later.

    The response of page n has id 2n and time n. The later request has id 2n + 1, comes
    after as many steps as the page's length says (up to 5,000), and is answered "not
    modified" with the page's own entity tag; so it resolves unless another capture of the
    same canonical url came in between.
    """
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    size = F.coalesce(F.length("html"), F.lit(0))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), size.cast("string"), F.lit("ETag"), tag, F.lit("Age"), F.lit("0"))
    brief = F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("Age"), (size % 100).cast("string"))
    n = F.col("page_id")
    first = pages.select((2 * n).alias("record_id"), "url", n.alias("at"), F.lit(200).alias("status"), full.alias("headers"), F.col("html").alias("payload"))
    later = pages.select((2 * n + 1).alias("record_id"), "url", (n + 1 + size % 5000).alias("at"), F.lit(304).alias("status"), brief.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.union(later)
