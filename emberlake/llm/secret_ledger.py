"""Secret scanning with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm.common import attach


@dataclass(frozen=True)
class Rule:
    """``pattern``'s matches whose ``group`` has at least ``least`` characters; a new ``version`` is scanned anew."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Kinds in the order in which spans that start together are listed.
RULES = [
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 or more is the whole run: shorter runs need not be listed to be dropped
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's spans, in order: what lies between the matches gives their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), tested.alias("part")), lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"),
        F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False)).alias("good"),
    ))
    empty = F.array().cast("array<struct<rule:string,kind:string,start:int,end:int>>")

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), start.alias("start"), (start + x["hit"]).alias("end"))
        spans = F.when(x["good"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((start + x["hit"]).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    listed = F.aggregate(steps, start, add, lambda done: done["spans"])
    return F.when(text.rlike(rule.pattern), listed).otherwise(empty)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``blob, scanned, spans``: per blob, the rule versions that were applied and what they found."""
    rows = spark.read.parquet(path)
    merged = rows.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return merged


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, first: bool = False) -> None:
    """Apply every rule version to every blob of ``versions`` (``text``) to which it wasn't applied yet.

    Appends one row per blob with work to ``ledger``, in one write: what was applied and
    what it found are never apart, so a run that broke off is simply repeated. Copies meet
    by digest and full text, combined in each task before they move.
    ``first``: there is no ledger yet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).dropDuplicates(["blob", "text"])
    names = F.array(*[F.lit(r.name) for r in rules])
    if first:
        todo = blobs.withColumn("todo", names)
    else:
        seen = read_ledger(versions.sparkSession, ledger).select("blob", "scanned")
        open_ = F.array_except(names, F.coalesce("scanned", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", open_).where(F.size("todo") > 0)
    none = F.array().cast("array<struct<rule:string,kind:string,start:int,end:int>>")
    parts = [F.when(F.array_contains("todo", r.name), _spans(F.col("text"), r)).otherwise(none) for r in rules]
    todo.select("blob", F.col("todo").alias("scanned"), F.concat(*parts).alias("spans")).write.mode("append").parquet(ledger)


def findings(paths: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Each row of ``paths`` (``path``, ``blob``) with the spans of the current ``rules``, ordered by start, then kind."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    names = F.array(*[F.lit(r.name) for r in rules])
    facts = read_ledger(paths.sparkSession, ledger)
    current = F.filter("spans", lambda s: F.array_contains(names, s["rule"]))
    keyed = F.transform(current, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    facts = facts.select("blob", F.sort_array(keyed).alias("spans"))
    return attach(paths, facts, ["blob"], ["path"])


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan_documents(docs: DataFrame, ledger: str, first: bool = True) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as paths of a first or later increment; one row per input row.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``; starts and ends are
    code points, ends exclusive. A null text counts as empty and has no spans; rows with
    equal texts are one blob with as many paths; null or repeated ids are kept as they
    are; other columns are not looked at; an empty table gives no rows.
    """
    scan_unseen(docs, ledger, first=first)
    paths = docs.select(F.col("doc_id").alias("path"), blob_of(F.col("text")).alias("blob"))
    found = findings(paths, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
