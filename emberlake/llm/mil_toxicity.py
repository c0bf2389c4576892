"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import by_value, held_out, map_rows, sample_by_hash
from emberlake.session import materialize

by_value(__name__)

#: Words, and the marks and line ends behind which a sentence is over.
TOKENS = re.compile(r"[^\W_]+|[.!?\n]+")
#: Numbers of sentences in a text that a model is fitted on start anew here, so that a key has 32 bits; the keys of a
#: text are in the order of its sentences, and a new number begins a new sentence.
SENTENCES = 1 << 15


@dataclass(frozen=True)
class Settings:
    documents: int = 8_000  # bound on the labelled rows a model is fitted on
    bins: int = 1 << 17
    rounds: int = 25
    rate: float = 0.05
    batch: int = 500
    decay: float = 1e-4
    least: int = 5  # documents of the sample in which a feature must be
    signal: float = 4.0  # standard errors by which a feature's documents must be toxic more often than others
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)  # letters of a word's start that count as features besides the word
    start: float = -7.0  # log odds of a sentence before anything is learned


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def bins_of(word: str, s: Settings) -> tuple[int, ...]:
    """The features of a word: itself and its starts, so that unseen forms of a stem are known."""
    forms = [word, *[word[:n] + "-" for n in s.prefixes if len(word) >= n]]
    return tuple(xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) % s.bins for f in forms)


def sentences(text: str | None) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    out: list[set[str]] = []
    now: set[str] = set()
    for token in TOKENS.findall((text or "").lower()):
        if token[0] in ".!?\n":
            if now:
                out.append(now)
                now = set()
        else:
            now.add(token)
    return [*out, now] if now else out


def _extract(s: Settings):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, tuple[int, ...]] = {}
            rows = []
            for text in batch["text"]:
                keys = []
                for i, words in enumerate(sentences(text)):
                    own: set[int] = set()  # a feature counts once in a sentence
                    for w in words:
                        if w not in known:
                            known[w] = bins_of(w, s)
                        own.update(known[w])
                    keys.extend([i % SENTENCES * s.bins + b for b in sorted(own)])
                rows.append(np.array(keys, dtype=np.uint32).tobytes())
            yield pd.DataFrame({"toxic": batch["toxic"], "words": rows})

    return extract


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _tally(s: Settings):
    """For each feature in how many documents of a task it is, and in how many toxic ones."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, bad = np.zeros(s.bins, dtype=np.int64), np.zeros(s.bins, dtype=np.int64)
        for batch in batches:
            for y, b in zip(batch["toxic"], batch["words"], strict=True):
                found = np.unique(np.frombuffer(b, dtype=np.uint32) % s.bins)
                seen[found] += 1
                bad[found] += y
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bin": at, "seen": seen[at], "bad": bad[at]})

    return tally


def telling(seen: np.ndarray, bad: np.ndarray, rows: int, toxic: int, s: Settings) -> np.ndarray:
    """The features (true or false for each) whose documents are toxic clearly more often than others."""
    share = min(0.99, max(0.01, toxic / rows))
    return (seen >= min(s.least, rows)) & (bad - share * seen > s.signal * np.sqrt(seen * share * (1 - share)))


def _keep_telling(kept: np.ndarray, s: Settings):
    packed = np.packbits(kept)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.unpackbits(packed, count=s.bins).astype(bool)
        for batch in batches:
            keys = [np.frombuffer(b, dtype=np.uint32) for b in batch["words"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "words": [k[kept[k % s.bins]].tobytes() for k in keys]})

    return pick


def fit_rows(rows: list[tuple[int, np.ndarray]], s: Settings) -> Model:
    """Maximise the likelihood of the document labels; a document is toxic unless all its sentences are not (noisy-or).

    A sentence's chance of being clean is ``exp(-softplus(z))``, so a document's is
    ``exp(-A)`` with ``A`` the sum of its sentences' ``softplus(z)``. The rows hold the keys of the
    ``telling`` features only.
    """
    w, bias = np.zeros(s.bins), s.start
    if not rows:
        return Model(w, bias)
    rng = np.random.default_rng(3)
    m, v, t = np.zeros(s.bins + 1), np.zeros(s.bins + 1), 0
    for _ in range(s.rounds):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // s.batch)):
            y = np.array([rows[i][0] for i in part], dtype=float)
            keys = np.concatenate([rows[i][1] for i in part]).astype(np.int64)
            doc = np.repeat(np.arange(len(part)), [len(rows[i][1]) for i in part])
            if not len(keys):
                continue
            number = keys // s.bins
            fresh = np.concatenate([[True], (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])])
            sentence, at = np.cumsum(fresh) - 1, keys % s.bins
            owner = doc[fresh]
            z = np.bincount(sentence, weights=w[at]) + bias
            a = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(part))
            slope = np.where(y > 0, -1 / np.expm1(np.maximum(a, 1e-9)), 1.0) / len(part)
            g = slope[owner] * _sigmoid(z)
            grad = np.append(np.bincount(at, weights=g[sentence], minlength=s.bins) + s.decay * w, g.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            bias -= step[-1]
    return Model(w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on at most about ``documents`` of the labelled rows of ``docs`` (``doc_id``, ``text``) outside the held-out fifth."""
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    open_ = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    ids = marked.where(~held_out(F.col("doc_id"))).join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = open_.join(sample_by_hash(ids, F.col("doc_id"), s.documents), "doc_id").select("toxic", "text")  # bounded by the settings
    stored = materialize(chosen.mapInPandas(_extract(s), "toxic int, words binary"), "toxicity-words")
    rows, toxic = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not rows:
        return fit_rows([], s)
    # the driver gets a row for each feature, then the keys of the telling ones: few, however long the texts are
    counts = stored.mapInPandas(_tally(s), "bin int, seen long, bad long").groupBy("bin").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toPandas()
    seen, bad = np.zeros(s.bins), np.zeros(s.bins)
    seen[counts["bin"]], bad[counts["bin"]] = counts["seen"], counts["bad"]
    # in the order of the whole keys, on which the batches depend; ranges are found by their first ones, so that little is sampled
    in_order = stored.repartitionByRange(8, "toxic", F.substring("words", 1, 16)).sortWithinPartitions("toxic", "words")
    got = in_order.mapInPandas(_keep_telling(telling(seen, bad, rows, toxic, s), s), "toxic int, words binary").toPandas()
    return fit_rows([(int(y), np.frombuffer(b, dtype=np.uint32)) for y, b in zip(got["toxic"], got["words"], strict=True)], s)


def _scores(text: str | None, model: Model, s: Settings, known: dict[str, tuple[int, ...]]) -> tuple[float, np.ndarray]:
    """The score of a text and those of its sentences."""
    z = []
    for words in sentences(text):
        bins: set[int] = set()
        for w in words:
            if w not in known:
                if len(known) > 500_000:
                    known.clear()
                known[w] = tuple(b for b in bins_of(w, s) if model.weights[b] != 0)
            bins.update(known[w])
        z.append(model.bias + float(model.weights[list(bins)].sum()) if bins else model.bias)
    each = np.array(z)
    return float(-np.expm1(-np.logaddexp(0, each).sum())), _sigmoid(each)


def _score(model: Model, s: Settings):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            found = [_scores(t, model, s, known) for t in batch["text"]]
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            yield pd.DataFrame({"doc_id": ids, "score": [x for x, _ in found], "sentences": [np.flatnonzero(e >= 0.5).tolist() for _, e in found]})

    return score


def scored_toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= ``cut``) and ``sentences``.

    ``sentences`` numbers, from 0, the sentences that are more likely toxic than not
    (sentences end at ``.``, ``!``, ``?`` or a line end; ones without letters or digits
    don't count). Null and empty texts score 0. Null ids count as held out. Null labels are
    left out; of repeated labels the worse counts. Repeated rows are each scored; long texts
    are used whole. Only texts are inputs of a score; other columns are not looked at. An
    empty table gives no rows. Without labels no text is called toxic by a single sentence.
    """
    model = fit(docs, labels, s)
    scores = map_rows(docs.select("doc_id", "text"), _score(model, s), "score double, sentences array<int>")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "sentences")


def clean_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, with all their columns."""
    model = fit(docs, labels, s)

    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:  # rows are picked as they are, no value is converted
            yield batch.filter(pa.array([_scores(t, model, s, known)[0] < cut for t in batch.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
