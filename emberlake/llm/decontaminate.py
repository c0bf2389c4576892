"""Benchmark decontamination: suffix arrays over the training texts, searched for every suffix of every test item."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import by_value

by_value(__name__)

#: Words in UTF-8 after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    window: int = 10  # words that must agree; an item of fewer is one window
    shard_words: int = 1 << 20  # words of documents in one suffix array; a longer document has one of its own
    block_words: int = 1 << 22  # words of test items that travel to the tasks at once
    spellings: int = 400_000  # distinct words of documents that a task remembers before it starts anew


@dataclass
class Tests:
    """A bounded block of test items as word numbers; number 0 ends an item, and is every word that no item has.

    ``suffixes`` are the starts of all suffixes that hold a window, sorted to their full depth.
    ``starts`` and ``sizes`` are one suffix for each different window, ``first`` and ``last`` the range of ``suffixes``
    that begin with it, and ``items`` the names of the items in which it occurs.
    """

    vocabulary: dict[bytes, int]
    words: np.ndarray
    owners: list[tuple[str | None, int]]  # item and its first place in ``words``, by that place
    suffixes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    items: list[list[str]]
    bits: int
    per_key: int

    @property
    def keys(self) -> int:
        return -(-int(self.sizes.max()) // self.per_key) if len(self.sizes) else 0


def words_of(text: bytes | None) -> list[bytes]:
    return WORD_BYTES.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only


def _sorted_suffixes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``words``, by ranks over prefixes that double."""
    rank, step = words.copy(), 1
    while True:
        ahead = np.append(rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64)) + 1
        pair = rank * (len(rank) + int(rank.max(initial=0)) + 2) + ahead
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(rank) or step >= len(rank):
            return starts[np.argsort(rank[starts], kind="stable")]
        step *= 2


def read_tests(rows: list[tuple], s: Settings) -> Tests:
    """Number the words of ``(item_id, text)`` rows, sort their suffixes and list their different windows."""
    vocabulary: dict[bytes, int] = {}
    numbers: list[int] = []
    owners, starts = [], []
    found: dict[tuple[int, ...], tuple[int, set]] = {}
    for item, text in rows:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(None if text is None else text.encode("utf-8", "surrogatepass"))]
        owners.append((None if item is None else str(item), len(numbers)))
        size = min(s.window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            starts.append(len(numbers) + i)
            _, names = found.setdefault(tuple(words[i : i + size]), (len(numbers) + i, set()))
            if item is not None:
                names.add(str(item))
        numbers.extend([*words, 0])
    order = sorted(found)
    bits = (len(vocabulary) + 1).bit_length()
    int64 = lambda x: np.array(x, dtype=np.int64)
    none = int64([])
    t = Tests(
        vocabulary, int64(numbers), owners, none, int64([found[w][0] for w in order]), int64([len(w) for w in order]), none, none,
        [sorted(found[w][1]) for w in order], bits, 63 // bits,
    )
    t.suffixes = _sorted_suffixes(t.words, int64(starts))
    t.first, t.last = _ranges([_pack(t.words, t.suffixes, k, t) for k in range(t.keys)], t)
    return t


def _pack(words: np.ndarray, starts: np.ndarray, key: int, t: Tests, sizes: np.ndarray | None = None, fill: int = 0) -> np.ndarray:
    """``per_key`` words from each start, as one number that sorts like them; from ``sizes`` on, ``fill``."""
    out = np.zeros(len(starts), dtype=np.int64)
    for j in range(key * t.per_key, (key + 1) * t.per_key):
        at = starts + j
        word = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
        out = (out << t.bits) | (word if sizes is None else np.where(j < sizes, word, fill))
    return out


def suffix_array(words: np.ndarray, t: Tests) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted starts of the suffixes of ``words`` that may hold a window, and their leading words, packed.

    Suffixes are sorted as deep as a window is long; equal ones stay in order of place. A
    suffix that meets a word unknown to all items before the shortest window is over matches nothing and is
    left out.
    """
    least = int(t.sizes.min())
    unknown = np.flatnonzero(words == 0)
    places = np.flatnonzero(words)
    ends = np.append(unknown, len(words))[np.searchsorted(unknown, places)]
    starts = places[ends - places >= least]
    keys = [_pack(words, starts, k, t) for k in range(t.keys)]
    order = np.lexsort(keys[::-1])
    return starts[order], [k[order] for k in keys]


def _bisect(low: np.ndarray, high: np.ndarray, below: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Many binary searches at once: for each, the first place of its range at which ``below(places, which)`` is false."""
    low, high = low.copy(), high.copy()
    while len(which := np.flatnonzero(low < high)):
        mid = (low[which] + high[which]) // 2
        under = below(mid, which)
        low[which[under]] = mid[under] + 1
        high[which[~under]] = mid[~under]
    return low


def _ranges(keys: list[np.ndarray], t: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the range of the sorted ``keys`` that begin with it."""
    out = []
    for fill, right in ((0, False), ((1 << t.bits) - 1, True)):
        wanted = [_pack(t.words, t.starts, k, t, t.sizes, fill) for k in range(t.keys)]

        def below(mid: np.ndarray, which: np.ndarray, wanted=wanted, right=right) -> np.ndarray:
            under, same = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
            for have, want in zip(keys, wanted, strict=True):
                under |= same & (have[mid] < want[which])
                same &= have[mid] == want[which]
            return under | same if right else under

        low = np.zeros(len(t.starts), dtype=np.int64)
        out.append(_bisect(low, low + (len(keys[0]) if keys else 0), below))
    return out[0], out[1]


def find(words: np.ndarray, t: Tests) -> tuple[np.ndarray, np.ndarray]:
    """``(window, place)`` for every place of ``words`` at which the window of a test suffix stands, by place."""
    none = np.zeros(0, dtype=np.int64)
    if not len(t.starts) or not len(words):
        return none, none
    places, keys = suffix_array(words, t)
    first, last = _ranges(keys, t)
    counts = last - first
    window = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    order = np.lexsort((-t.sizes[window], places[at]))
    return window[order], places[at][order]


def grow(words: np.ndarray, t: Tests, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest verbatim match from each place on: its words, and the start of the test suffix.

    All suffixes that begin with the window are narrowed word by word to those that go on like the text.
    """
    size, first, last = t.sizes[window].copy(), t.first[window].copy(), t.last[window].copy()
    going = np.arange(len(window))
    while len(going):
        at = place[going] + size[going]
        want = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
        going, want = going[want > 0], want[want > 0]
        after = lambda mid, which: t.words[np.minimum(t.suffixes[mid] + size[going[which]], len(t.words) - 1)]  # noqa: B023, E731
        low = _bisect(first[going], last[going], lambda mid, which: after(mid, which) < want[which])  # noqa: B023
        high = _bisect(low, last[going], lambda mid, which: after(mid, which) <= want[which])  # noqa: B023
        more = low < high
        going = going[more]
        first[going], last[going] = low[more], high[more]
        size[going] += 1
    return size, t.suffixes[first] if len(first) else first


@dataclass
class Shard:
    """Documents of a task that share a suffix array, as word numbers with a 0 behind each."""

    numbers: list[np.ndarray] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    size: int = 0

    def add(self, words: np.ndarray) -> None:
        self.numbers.append(words)
        self.size += len(words) + 1
        self.ends.append(self.size)

    def matches(self, t: Tests) -> tuple[np.ndarray, ...]:
        """``(document, place in it, window, words that agree, start of the test suffix)`` of all matches, by document and place."""
        words = np.zeros(self.size, dtype=np.int64)
        begin = 0
        for part, end in zip(self.numbers, self.ends, strict=True):
            words[begin : end - 1] = part
            begin = end
        window, place = find(words, t)
        doc = np.searchsorted(self.ends, place, side="right")
        return doc, place - np.append(0, self.ends)[doc], window, *grow(words, t, window, place)


class _Numbers(dict):
    """Numbers of the words of documents, by their spelling."""

    def __init__(self, t: Tests):
        self.known = t.vocabulary.get

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.known(word, 0)
        return number


SPAN = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])
HIT_COLUMNS = [("_n_words", pa.int64()), ("_hits", pa.list_(pa.list_(pa.int64()))), ("_items", pa.list_(pa.string())), ("_spans", pa.list_(SPAN))]
HITS = "_n_words long, _hits array<array<long>>, _items array<string>, _spans array<struct<first_word: long, words: long, item_id: string, item_word: long>>"


def _shard_rows(shard: Shard, t: Tests) -> list[tuple]:
    """For each document of the shard: its count of words, ranges of hit words, items and longest matches."""
    doc, place, window, size, start = shard.matches(t)
    bounds = np.searchsorted(doc, np.arange(len(shard.ends) + 1))
    begins = [b for _, b in t.owners]
    out = []
    for d, words in enumerate(shard.numbers):
        own = slice(bounds[d], bounds[d + 1])
        if own.start == own.stop:
            out.append((len(words), None, None, None))
            continue
        at, windows = place[own], window[own]
        marks = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + t.sizes[windows], minlength=len(words) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(marks) > 0]).astype(np.int8)))
        items = sorted({i for k in np.unique(windows) for i in t.items[k]})
        # a match that ends no later than one that began before it is a part of that one
        reach = at + size[own]
        longer = np.flatnonzero(reach > np.append(-1, np.maximum.accumulate(reach)[:-1]))
        spans = []
        for k in longer:
            item, begin = t.owners[np.searchsorted(begins, start[own][k], side="right") - 1]
            spans.append({"first_word": int(at[k]), "words": int(size[own][k]), "item_id": item, "item_word": int(start[own][k]) - begin})
        out.append((len(words), edges.reshape(-1, 2).tolist(), items, spans))
    return out


def _merged(old: list | None, new: list | None) -> list | None:
    """The union of two lists of ranges."""
    out: list[list[int]] = []
    for begin, end in sorted([*(old or ()), *(new or ())]):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out or None


def _searcher(t: Tests, s: Settings, keep_text: bool, first: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, waiting = _Numbers(t), Shard(), []

        def flush():
            nonlocal shard, waiting
            rows = _shard_rows(shard, t) if shard.ends else []
            done = 0
            for batch in waiting:
                part = rows[done : done + batch.num_rows]
                done += batch.num_rows
                columns = {n: batch.column(n) for n in batch.schema.names}
                if not first:
                    old = [columns.pop(n).to_pylist() for n, _ in HIT_COLUMNS]
                    part = [(n, _merged(h0, h), sorted({*(i0 or ()), *(i or ())}) or None, (x0 or []) + (x or []) or None) for (n, h, i, x), h0, i0, x0 in zip(part, *old[1:], strict=True)]
                for k, (name, kind) in enumerate(HIT_COLUMNS):
                    columns[name] = pa.array([row[k] for row in part], type=kind)
                if not keep_text:
                    columns.pop("_text")
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            shard, waiting = Shard(), []

        for batch in batches:
            begin = 0
            texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.large_binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                words = words_of(text)
                if len(known) > s.spellings:
                    known.clear()
                shard.add(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
                if shard.size >= s.shard_words:
                    waiting.append(batch.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield from flush()
            if begin < batch.num_rows:
                waiting.append(batch.slice(begin))
        yield from flush()

    return search


def searched(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of every row of ``docs`` (``text``) with what the items of ``benchmark`` (``item_id``, ``text``) hit in it.

    ``_n_words``; ``_hits``: the ranges of hit words; ``_items``: names of the items with a
    window in the text; ``_spans``: the longest verbatim matches and where they begin in the text and in an item. Documents stay where they are: each
    task builds suffix arrays over its own documents, shard by shard, and searches every
    test suffix in each. Test items travel in blocks of bounded size, one pass for each block.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    words = benchmark.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-words // (4 * s.block_words)))  # at four bytes a word
    kept = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    schema = kept.drop("_text").schema.simpleString()[len("struct<") : -1]
    for block in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        tests = read_tests([tuple(r) for r in part.select("item_id", "text").distinct().collect()], s)  # bounded by block_words
        last = block == blocks - 1
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in {"_text", *dict(HIT_COLUMNS)})
        kept = kept.mapInArrow(_searcher(tests, s, not last, block == 0), f"{fields}, {'' if last else '_text string, '}{HITS}")
    return kept


def judged(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest`` for every row of ``docs``.

    A document's word is hit if it stands in an occurrence of a window of ``s.window``
    consecutive words of a test item; an item of fewer words, but not none, is one window.
    ``items_sha256`` is over the item ids in order as strings, joined by commas; ``longest``
    is the most words that agree with an item verbatim. Null and empty texts have no words and
    are clean; a null item id hits words but is in no list; repeated items count once, repeated documents are
    judged one by one. Null document ids stay null. Texts of any length are searched
    whole. An empty benchmark hits nothing.
    """
    found = searched(docs, benchmark, s)
    ranges = F.coalesce("_hits", F.array().cast("array<array<long>>"))
    n_hit = F.aggregate(ranges, F.lit(0).cast("long"), lambda total, x: total + x[1] - x[0])
    items = F.coalesce("_items", F.array().cast("array<string>"))
    longest = F.coalesce(F.array_max(F.transform("_spans", lambda x: x["words"])), F.lit(0).cast("long"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), longest.alias("longest"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of a test item."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    renamed = docs.toDF(*names).withColumn("text", F.col(text))
    clean = searched(renamed, benchmark, s, tuple(names)).where("_hits is null").select(*names)
    return clean.toDF(*docs.columns)


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The longest verbatim matches and where they are: ``doc_id, first_word, words, item_id, item_word``.

    Of each place of a text the longest match with any item (ties: one of them) counts; one that lies inside another is
    not listed.
    """
    return searched(docs, benchmark, s).select("doc_id", F.inline("_spans"))
