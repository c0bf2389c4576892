"""Quality rules whose cutoffs are chosen with a bounded risk of rejecting good documents."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import WORDS, attach, by_value, map_rows
from emberlake.session import materialize

by_value(__name__)

SYMBOLS = "#*$%&|<>"
_STRIP = str.maketrans("", "", SYMBOLS)
SPAN = 8


@dataclass(frozen=True)
class Risk:
    """Rules reject values above a cutoff. In each stratum, with probability ``1 - doubt`` over the holdout, at most ``share`` of good documents is rejected, by all rules together."""

    share: float = 0.02
    doubt: float = 0.05
    cutoffs: Mapping[str, Sequence[float]] = field(default_factory=lambda: {
        "symbols": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3), "dup_lines": (0.1, 0.2, 0.3, 0.5, 0.7), "repeats": (0.05, 0.1, 0.2, 0.3),
        "upper": (0.1, 0.2, 0.3, 0.5, 0.7), "word_length": (8.0, 10.0, 12.0, 15.0, 20.0, 40.0),
    })


def repeated_words(docs: list[list[str]]) -> np.ndarray:
    """Per list of words, how many of them lie in runs of ``SPAN`` words found twice or more in that list.

    Runs are compared exactly: words are numbered, then pairs of numbers, pairs of pairs
    and pairs of those, always with the document's number.
    """
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in docs for w in words], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(words) for words in docs])
    out = np.zeros(len(docs), dtype=np.int64)
    if len(ids) < SPAN:
        return out
    rank, step = ids, 1
    while step < SPAN:
        if len(rank) <= step:
            return out
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    inside = doc[: len(rank)] == doc[SPAN - 1 :]
    key = doc[: len(rank)] * (int(rank.max()) + 1) + rank
    _, back, count = np.unique(key[inside], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(inside)[count[back] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + SPAN, -1)
    np.add.at(out, doc[np.cumsum(edge)[:-1] > 0], 1)
    return out


def measure(texts: list[str | None]) -> pd.DataFrame:
    """The base counts of whole texts."""
    texts = [t or "" for t in texts]
    words = [WORDS.findall(t) for t in texts]
    lines = [[x for x in t.split("\n") if WORDS.search(x)] for t in texts]
    return pd.DataFrame({
        "n_words": [len(w) for w in words], "word_chars": [sum(map(len, w)) for w in words], "n_symbols": [len(t) - len(t.translate(_STRIP)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines], "n_repeat_words": repeated_words(words), "n_lines": [len(x) for x in lines],
        "n_upper": [sum(1 for x in w if len(x) > 1 and x.isupper()) for w in words],
    }, dtype="int64")


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            at, size = 0, 0
            for i, text in enumerate(whole["text"].tolist()):
                size += len(text or "")
                if size >= 500_000 or i == len(whole) - 1:
                    batch, size = whole.iloc[at : i + 1], 0
                    at = i + 1
                    counts = measure(batch["text"].tolist())
                    counts.insert(0, "doc_id", batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist())
                    counts.insert(1, "stratum", batch["stratum"].tolist())
                    yield counts

    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
    rows = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return map_rows(rows, run, f"stratum string, {names}")


def _values() -> dict:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"),
        "upper": over("n_upper", "n_words"), "word_length": over("word_chars", "n_words"),
    }


def below(rejected: int, n: int, share: float) -> float:
    """The chance of at most ``rejected`` among ``n`` if each is rejected with probability ``share``.

    The exact (Clopper-Pearson) upper bound of the rate at confidence ``1 - d`` is at most
    ``share`` just when this chance is at most ``d``.
    """
    if rejected >= n:
        return 1.0
    k = np.arange(rejected)
    logs = np.cumsum(np.concatenate([[n * np.log1p(-share)], np.log((n - k) / (k + 1)) + np.log(share / (1 - share))]))
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def steps_of(risk: Risk) -> list[tuple[str, int]]:
    """The tightenings in their fixed order: ``(rule, place of its cutoff)``, the rules in turn, each from its loosest cutoff on."""
    most = max(map(len, risk.cutoffs.values()), default=0)
    return [(r, len(c) - 1 - k) for k in range(most) for r, c in risk.cutoffs.items() if k < len(c)]


def choose_cutoffs(holdout: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``stratum, cuts`` (map of rule to cutoff) from good documents (``stratum`` and the counts of ``measured``).

    The rules are tightened one step at a time in a fixed order (``steps_of``), from none to
    all cutoffs, and after each step the documents that any rule rejects are counted. A
    stratum takes the last step before the first whose exact upper bound of false rejection is
    above ``share``. As the order is fixed beforehand and testing ends at the first failure,
    the steps of a stratum need no correction; the doubt is divided by the strata, so all bounds hold together.
    Documents are counted by step before they move; a stratum's task gets one row per step.
    """
    values, steps = _values(), steps_of(risk)
    order = {step: i for i, step in enumerate(steps)}
    # the first step that rejects a document: of each rule, the first whose cutoff is below its value
    first = [
        F.coalesce(*[F.when(values[r] > c[i], F.lit(order[r, i])) for i in reversed(range(len(c)))], F.lit(len(steps))) for r, c in risk.cutoffs.items()
    ]
    counts = holdout.select("stratum", F.array_min(F.array(F.lit(len(steps)), *first)).alias("step")).groupBy("stratum", "step").count()
    counts = materialize(counts, "risk-counts")
    doubt = risk.doubt / max(1, counts.select("stratum").distinct().count())
    cutoffs = {r: list(map(float, c)) for r, c in risk.cutoffs.items()}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cuts, n = {}, int(rows["count"].sum())
        for i, (rule, at) in enumerate(steps):
            if below(int(rows.loc[rows["step"] <= i, "count"].sum()), n, risk.share) > doubt:
                break
            cuts[rule] = cutoffs[rule][at]
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "cuts": [cuts]})

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, cuts map<string,double>")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``, the stratum) with its counts and verdict.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, rejected_by``. ``base_failed``: under 20 words, or over 30 % of the words in repeated
    8-word runs. Otherwise a row is kept unless a value is above its stratum's certified
    cutoff (``choose_cutoffs`` over the documents labelled 1). The rule list is fixed; with
    too few labels no cutoff is certified and only the base rules reject.

    Null and empty texts have no words and fail; a null stratum is a stratum; null labels
    and labels of unknown documents are left out, repeated ones count once; repeated rows
    are each judged; long texts are used whole; other columns are not looked at; an empty
    table gives no rows.
    """
    rows = materialize(measured(docs, stratum), "risk-measures")
    good = labels.where("quality = 1").select("doc_id").distinct()
    cuts = choose_cutoffs(rows.join(good, "doc_id", "left_semi"), risk)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    values = _values()
    found = F.array_compact(F.array(*[F.when(values[r] > F.col("cuts")[r], F.lit(r)) for r in risk.cutoffs]))
    out = attach(rows, materialize(cuts, "risk-cuts"), ["stratum"], ["doc_id"], "left").withColumn("base_failed", failed).withColumn("rejected_by", found)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*base, (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by"))
