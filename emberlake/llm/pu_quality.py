"""Quality classification from positive and unlabelled texts with a non-negative unbiased risk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import WORDS, by_value, held_out, map_rows, sample_by_hash

by_value(__name__)

#: Runs of one kind of character, for the shape of a word.
KINDS = [(re.compile("[A-ZÄÖÜÀ-ÝŒ]+"), "X"), (re.compile("[a-zà-ÿœß]+"), "x"), (re.compile("[0-9]+"), "9"), (re.compile(r"(\W)\1+"), r"\1\1")]


@dataclass(frozen=True)
class Settings:
    positives: int = 6000  # bound on the labelled rows a model is fitted on
    unlabelled: int = 12_000  # bound on the unlabelled rows
    word_bins: int = 1 << 15
    shape_bins: int = 1 << 12
    rounds: int = 30
    rate: float = 0.05
    batch: int = 400
    decay: float = 1e-4

    @property
    def width(self) -> int:
        return self.word_bins + self.shape_bins + 64


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def shape_of(word: str) -> str:
    for pattern, to in KINDS:
        word = pattern.sub(to, word)
    return word[:12]


def _bins(word: str, s: Settings) -> tuple[int, int]:
    bare = word.lower().encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(bare) % s.word_bins, s.word_bins + xxhash.xxh3_64_intdigest(shape_of(word).encode("utf-8", "surrogatepass")) % s.shape_bins


def features(text: str | None, s: Settings, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: shares of its words and word shapes, and bands of a few ratios."""
    words = WORDS.findall(text or "")
    n = len(words)
    dense = s.word_bins + s.shape_bins
    if not n:
        return np.array([dense], dtype=np.int32), np.ones(1, dtype=np.float32)
    counts = Counter(words)
    for w in counts:
        if w not in known:
            known[w] = _bins(w, s)
    pairs = np.array([known[w] for w in counts], dtype=np.int32)
    share = np.fromiter(counts.values(), dtype=np.float32, count=len(counts)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    ratios = [
        min(7, int(np.log2(n))), int(7 * len(counts) / n), int(7 * len(set(lines)) / max(1, len(lines))), min(7, int(sum(map(len, words)) / n / 2)),
        int(7.99 * sum(map(str.isupper, words)) / n), min(7, int(np.log2(1 + len(lines)))), min(7, int(np.log2(1 + 200 * sum(map(str.__eq__, words, words[1:])) / n))),
    ]
    bands = np.array([dense + 1 + 8 * i + r for i, r in enumerate(ratios)], dtype=np.int32)
    values = np.concatenate([0.3 * np.sqrt(share), 4 * share, np.ones(len(bands), dtype=np.float32)])
    return np.concatenate([pairs[:, 0], pairs[:, 1], bands]), values.astype(np.float32)


def _extract(s: Settings):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict = {}
            rows = [features(t, s, known) for t in batch["text"]]
            yield pd.DataFrame({"positive": batch["positive"], "at": [a.tobytes() for a, _ in rows], "value": [v.tobytes() for _, v in rows]})

    return extract


def class_prior(labels: DataFrame) -> float:
    """The share of positives among the labelled rows from which labels may be learned."""
    got = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return min(0.99, max(0.01, got if got is not None else 0.5))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit_rows(rows: list[tuple[bool, np.ndarray, np.ndarray]], prior: float, s: Settings) -> Model:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss, by Adam.

    Where the part under the maximum falls below zero in a batch, the step goes against its
    gradient, which undoes the overfitting that made it negative.
    """
    positive = np.array([r[0] for r in rows], dtype=bool)
    model = Model(np.zeros(s.width), 0.0, prior)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(pos) or not len(unl):
        return Model(model.weights, float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(3)
    m, v, t = np.zeros(s.width + 1), np.zeros(s.width + 1), 0
    steps = max(1, -(-len(unl) // s.batch))
    for _ in range(s.rounds):
        parts_p, parts_u = np.array_split(rng.permutation(pos), min(steps, len(pos))), np.array_split(rng.permutation(unl), steps)
        for k in range(steps):
            p, u = parts_p[k % len(parts_p)], parts_u[k]
            both = np.concatenate([p, u])
            at = np.concatenate([rows[i][1] for i in both])
            value = np.concatenate([rows[i][2] for i in both])
            who = np.repeat(np.arange(len(both)), [len(rows[i][1]) for i in both])
            z = np.bincount(who, weights=model.weights[at] * value, minlength=len(both)) + model.bias
            zp, zu = z[: len(p)], z[len(p) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gu, gp_minus, gp_plus = _sigmoid(zu) / len(u), -prior * _sigmoid(zp) / len(p), -prior * _sigmoid(-zp) / len(p)
            g = np.concatenate([gp_plus + gp_minus, gu]) if negative >= 0 else -np.concatenate([gp_minus, gu])
            grad = np.append(np.bincount(at, weights=g[who] * value, minlength=s.width) + s.decay * model.weights, g.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            model.weights -= step[:-1]
            model.bias -= step[-1]
    return model


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on at most about ``positives`` labelled and ``unlabelled`` other rows of ``docs`` (``doc_id``, ``text``).

    Positives are the rows labelled 1 outside the held-out fifth; the unlabelled are rows of
    the whole corpus outside it, whatever their label. Of a zero label only the count
    enters, in the class prior.
    """
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    open_ = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    ids = open_.select("doc_id").distinct()
    p = sample_by_hash(ids.join(trusted, "doc_id", "left_semi"), F.col("doc_id"), s.positives).withColumn("positive", F.lit(True))
    u = sample_by_hash(ids, F.reverse(F.col("doc_id").cast("string")), s.unlabelled).withColumn("positive", F.lit(False))
    chosen = open_.join(p.union(u), "doc_id").select("positive", "text")  # bounded by the settings
    got = chosen.mapInPandas(_extract(s), "positive boolean, at binary, value binary").toPandas()
    order = np.lexsort([got["at"], got["positive"]]) if len(got) else []
    got = got.iloc[order]
    rows = [(bool(p), np.frombuffer(a, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for p, a, v in zip(got["positive"], got["at"], got["value"], strict=True)]
    return fit_rows(rows, class_prior(labels), s)


def score_texts(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, from its whole text."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                if len(known) > 500_000:
                    known.clear()
                at, value = features(text, s, known)
                out.append(float(_sigmoid(np.array(model.weights[at] @ value + model.bias))))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), "score": out})

    return map_rows(docs.select("doc_id", "text"), score, "score double")


def scored_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= ``cut``).

    Null and empty texts are scored as texts without words. Null ids count as held out.
    Labels with a null are left out; repeated labels count once as positives. Repeated rows
    are each scored. Without positives every score is the class prior. Only texts
    are inputs of a score; other columns are not looked at. An empty table gives no rows.
    """
    scores = score_texts(docs, fit(docs, labels, s), s)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
