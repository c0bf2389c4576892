"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest common prefixes, depth by region."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import ROWS_PER_SALT, UPPER, WORDS, attach, by_value, map_rows
from emberlake.llm.components import components
from emberlake.operators.skew import salted_join
from emberlake.session import fresh_path, materialize

by_value(__name__)
LOWER = str.maketrans(UPPER, UPPER.lower())
#: Shingles whose minima are taken in one go: what numpy works on at a time stays in the cache.
CHUNK = 65_536
#: Counters in which shingles are counted to order them by how rare they are: a shingle's first bits name its counter.
COUNTER_BITS = 20


@dataclass(frozen=True)
class Forest:
    words: int = 5  # of a shingle
    hundredths: int = 80  # least similarity of a link
    hashes: int = 128
    trees: int = 24
    depth: int = 10  # values in a tree's label
    least_depth: int = 4  # of the common prefix of candidates
    window: int = 48  # neighbours looked at in a region that has more at the least depth; the rest is left to ``rare_links``
    of_one: int = 8  # of them, rows of one component; likewise
    listed: int = 4  # a row with more candidates in a tree has them tested where it lies, not listed as pairs
    bits: int = 30  # of the 128 sketch bits in which candidates may differ

    def values(self) -> np.ndarray:
        """The signature places of each tree."""
        rng = np.random.default_rng(5)
        return np.stack([rng.permutation(self.hashes)[: self.depth] for _ in range(self.trees)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int, known: dict[str, int]) -> np.ndarray:
    """The distinct ``k``-word shingles of a text as sorted 64-bit hashes; ``known`` keeps the words' hashes.

    Two sets of a million shingles have a clash with a chance below one in ten million.
    """
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.array([known[w] for w in words], dtype=np.uint64)
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def _sets_of(batch: pd.DataFrame, k: int) -> list[np.ndarray]:
    known: dict[str, int] = {}
    sets = []
    for text in batch["text"]:
        if len(known) > 1_000_000:
            known.clear()
        sets.append(shingle_set(text, k, known))
    return sets


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The least value of each of ``hashes`` functions over each set; sets are not empty."""
    odd = np.random.default_rng(11).integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), hashes), dtype=np.uint64)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (n == 0 or n + len(sets[to]) <= CHUNK):
            n += len(sets[to])
            to += 1
        every = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *[len(s) for s in sets[at : to - 1]]])
        for i, a in enumerate(odd):
            out[at:to, i] = np.minimum.reduceat((every * a) >> np.uint64(32), starts)
        at = to
    return out


def _features(forest: Forest):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.iloc[start : start + 500]
                sets = _sets_of(batch, forest.words)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                values = np.zeros((len(sets), forest.hashes), dtype=">u2")
                sketch = np.zeros((len(sets), 2), dtype=np.int64)
                if len(full):
                    least = signatures([sets[i] for i in full], forest.hashes)
                    values[full] = (least & np.uint64(0xFFFF)).astype(">u2")
                    bits = np.packbits(((_mixed(least) >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)[:, :128], axis=1)
                    sketch[full] = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 16 - bits.shape[1])))).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist(),
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "n": n, "values": [v.tobytes() if k else None for v, k in zip(values, n, strict=True)], "s0": sketch[:, 0], "s1": sketch[:, 1],
                })

    return features


def _labels(forest: Forest, trees: range):
    places = forest.values()

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 2000):
                batch = whole.iloc[start : start + 2000]
                values = np.frombuffer(b"".join(batch["values"]), dtype=">u2").reshape(len(batch), forest.hashes)
                for tree in trees:
                    rows = np.ascontiguousarray(values[:, places[tree]])
                    yield batch[["cls", "comp", "n", "s0", "s1"]].assign(tree=np.int32(tree), label=[r.tobytes() for r in rows])

    return labels


def _common(a: np.ndarray) -> np.ndarray:
    """How many leading values each row shares with the row before it."""
    same = a[1:] == a[:-1]
    return np.concatenate([[0], np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))])


def _alike(p: np.ndarray, q: np.ndarray, forest: Forest) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= forest.hundredths * (len(p) + len(q) - both)


def _neighbours(rows: pd.DataFrame, forest: Forest, window: int, split: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Rows in the forest's order with their candidates, as positions: ``(i, [(differing bits, j), ...])``.

    A row looks back, over the stretch that shares ``least_depth`` values with it, at the
    nearest rows of other components: those with the longest common prefixes. Sizes and
    sketches rule out what can't be a link. ``split``: only pairs that lie in different partitions.
    """
    n = len(rows)
    if n < 2:
        return
    width = 2 * forest.depth
    label = np.frombuffer(b"".join(rows["label"]), dtype=">u2").reshape(n, width // 2)
    tree = rows["tree"].to_numpy()
    shared = _common(label)
    shared[1:][tree[1:] != tree[:-1]] = 0
    comp, size = rows["comp"].tolist(), rows["n"].tolist()
    s0, s1 = rows["s0"].tolist(), rows["s1"].tolist()
    m64, h = (1 << 64) - 1, forest.hundredths
    recent: list[int] = []
    for i in np.flatnonzero(np.concatenate([shared[1:] >= forest.least_depth, [False]]) | (shared >= forest.least_depth)).tolist():
        if shared[i] < forest.least_depth:
            recent = []
        mine, seen = comp[i], []
        for j in reversed(recent):
            if comp[j] == mine or (split is not None and split[j] == split[i]):
                continue
            a, b = (size[i], size[j]) if size[i] < size[j] else (size[j], size[i])
            if 100 * a >= h * b:
                far = ((s0[i] ^ s0[j]) & m64).bit_count() + ((s1[i] ^ s1[j]) & m64).bit_count()
                if far <= forest.bits:
                    seen.append((far, j))
        if seen:
            yield i, seen
        # a row that leaves the view has been put down in ``_Stretches``, and ``rare_links`` finds its other links
        same = [k for k in recent if comp[k] == mine]
        if len(same) >= forest.of_one:
            recent.remove(same[0])
        recent.append(i)
        if len(recent) > window:
            recent.pop(0)


def _closest(rows: pd.DataFrame, forest: Forest, window: int, split: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Of each row's candidates the one with the nearest sketch."""
    cls = rows["cls"].tolist()
    best = [(i, min(seen)[1]) for i, seen in _neighbours(rows, forest, window, split)]
    yield pd.DataFrame({"kind": 0, "a": [cls[i] for i, _ in best], "b": [cls[j] for _, j in best]})


def _listed(rows: pd.DataFrame, forest: Forest, window: int, split: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Pairs of rows with few candidates; of the others the rows themselves, with those they are to be tested with (``kind`` 2)."""
    cls, pairs, crowd = rows["cls"].tolist(), [], set()
    for i, seen in _neighbours(rows, forest, window, split):
        if len(seen) <= forest.listed:
            pairs += [(i, j) for _, j in seen]
        else:
            crowd |= {i, *[j for _, j in seen]}
    yield pd.DataFrame({"kind": 0, "a": [cls[i] for i, _ in pairs], "b": [cls[j] for _, j in pairs]})
    if crowd:
        yield rows.iloc[sorted(crowd)].assign(kind=2, a=None, b=None)


def _tested(rows: pd.DataFrame, forest: Forest, window: int, split: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The links among rows that bring their sets (``x``)."""
    cls, sets = rows["cls"].tolist(), [np.frombuffer(x, dtype=np.uint64) for x in rows["x"]]
    links, known = [], {}
    for i, seen in _neighbours(rows, forest, window, split):
        for _, j in seen:
            pair = (cls[i], cls[j]) if cls[i] > cls[j] else (cls[j], cls[i])
            if pair not in known:
                known[pair] = _alike(sets[i], sets[j], forest)
                if known[pair]:
                    links.append(pair)
    yield pd.DataFrame({"kind": 0, "a": [a for a, _ in links], "b": [b for _, b in links]})


def _aligned(found: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    for out in found:
        if len(out):
            yield out.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)


class _Stretches:
    """The rows of stretches that share the least depth and may hold more rows than stay in view.

    Those are the stretches of more rows than ``of_one`` (or the window, if that is less),
    and those cut by an end of the partition, whose other part isn't known here.
    """

    def __init__(self, forest: Forest):
        self.least, self.depth = min(forest.of_one, forest.window), forest.least_depth
        self.held: list[pd.DataFrame] = []
        self.last, self.size, self.open = None, 0, True

    def of(self, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = batch[["tree", "label", "cls"]].assign(label=[x[: 2 * self.depth] for x in batch["label"]])
        tree, label = rows["tree"].to_numpy(), rows["label"].to_numpy()
        last = (tree[-1], label[-1])
        fresh = np.concatenate([[self.last is not None and self.last != (tree[0], label[0])], (tree[1:] != tree[:-1]) | (label[1:] != label[:-1])])
        # stretch 0 is the one that was open before; the partition's first one is open in front
        stretch = np.cumsum(fresh)
        sizes = np.bincount(stretch)
        sizes[0] += self.size
        keep = sizes > self.least
        keep[0] |= self.open
        if keep[0] and not fresh[0]:
            yield from self.end()
        if keep[stretch].any():
            yield rows[keep[stretch]].assign(kind=3, a=None, b=None)
        if stretch[-1]:
            self.held, self.open = [], False
        if not keep[-1]:
            self.held.append(rows[stretch == stretch[-1]])
        elif stretch[-1] == 0:
            self.held = []
        self.last, self.size = last, int(sizes[-1])

    def end(self) -> Iterator[pd.DataFrame]:
        if self.held:
            yield pd.concat(self.held).assign(kind=3, a=None, b=None)


def _swept(forest: Forest, window: int, step, names: list[str]):
    """What ``step`` finds within each partition, its first and last rows for the seams (``kind`` 1), and crowded stretches (``kind`` 3)."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        carry: pd.DataFrame | None = None
        seen, tail = 0, None
        stretches = _Stretches(forest) if step is _listed else None
        for batch in batches:
            batch = batch.reset_index(drop=True)
            if stretches:
                for found in stretches.of(batch):
                    yield found.assign(part=part)
            if seen < window:
                yield batch.iloc[: window - seen].assign(kind=1, part=part, a=None, b=None)
            first = max(0, window - seen)
            seen += len(batch)
            rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            # rows carried over were paired among themselves; pairs that come twice are made distinct later
            for found in step(rows, forest, window):
                yield found.assign(part=part)
            carry = rows.iloc[-window:]
            late = batch.iloc[first:]
            tail = (late if tail is None else pd.concat([tail, late])).iloc[-window:]
        if tail is not None and len(tail):
            yield tail.assign(kind=1, part=part, a=None, b=None)
        if stretches:
            for found in stretches.end():
                yield found.assign(part=part)

    return lambda batches: _aligned(sweep(batches), names)


def _stitched(forest: Forest, window: int, step, names: list[str]):
    """What ``step`` finds across the partitions that meet in one seam."""

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "label", "cls"], kind="stable").reset_index(drop=True)
        found = list(_aligned(step(rows, forest, window, rows["part"].to_numpy()), names))
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    return stitch


def _seams(ends: DataFrame, window: int) -> DataFrame:
    """``part, seam``: a partition's first rows meet, in its own seam, the last ``window`` rows before them.

    Made from one count per partition, so it grows with the number of partitions alone.
    """
    counts = sorted((r["part"], r["count"]) for r in ends.groupBy("part").count().collect())
    meets = []
    for at, (part, _) in enumerate(counts):
        meets.append((part, part))
        before, back = 0, at
        while back and before < window:
            back -= 1
            before += counts[back][1]
            meets.append((counts[back][0], part))
    return ends.sparkSession.createDataFrame(meets, "part int, seam int")


def _sweep(rows: DataFrame, forest: Forest, window: int, step) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``step`` over ``rows`` in the order of tree, label and class: its pairs, its rows of ``kind`` 2, and those of crowded stretches.

    All trees are one table, sorted over range partitions, so a crowded label is cut like
    any other stretch. The few rows at both ends of a partition (no more than two windows)
    are swept once more across each seam, every seam by itself.
    """
    spark = rows.sparkSession
    kind = rows.schema["cls"].dataType.simpleString()
    kinds = {"tree": "int", "label": "binary", "cls": kind, "comp": kind, "n": "int", "s0": "long", "s1": "long", "x": "binary"}
    own = [c for c in kinds if c in rows.columns]
    shape = f"kind int, part int, a {kind}, b {kind}, " + ", ".join(f"{c} {kinds[c]}" for c in own)
    names = ["kind", "part", "a", "b", *own]
    ordered = rows.select(*own).repartitionByRange("tree", "label", "cls").sortWithinPartitions("tree", "label", "cls")
    path = fresh_path(spark, "forest")
    ordered.mapInPandas(_swept(forest, window, step, names), shape).write.partitionBy("kind").parquet(path)
    swept = spark.read.schema(shape).parquet(path)
    ends = swept.where("kind = 1").drop("kind", "a", "b")
    met = ends.join(F.broadcast(_seams(ends, window)), "part").groupBy("seam").applyInPandas(_stitched(forest, window, step, names), shape)
    found = swept.where("kind in (0, 2)").select(*names).union(materialize(met, "forest-seams"))
    crowded = swept.where("kind = 3").select("tree", "label", "cls")
    return found.where("kind = 0").select("a", "b"), found.where("kind = 2").select(*own), crowded


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def planted(nodes: DataFrame, forest: Forest, trees: range) -> DataFrame:
    """A row per class and tree, with its label there, of ``nodes`` (``cls, comp, n, values, s0, s1``)."""
    kind = nodes.schema["cls"].dataType.simpleString()
    return nodes.mapInPandas(_labels(forest, trees), f"cls {kind}, comp {kind}, n int, s0 long, s1 long, tree int, label binary")


def bulk_links(nodes: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """Links between rows and their closest neighbour in a narrow view of some trees: most of what joins large groups."""
    pairs, _, _ = _sweep(planted(nodes, forest, range(max(1, forest.trees // 3))), forest, 8, _closest)
    return confirmed(materialize(_pairs(pairs), "forest-pairs"), docs, forest)


def forest_links(nodes: DataFrame, docs: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """Links to all candidates in view in all trees, and the rows of stretches that hold more (``tree, label, cls``).

    Rows with few candidates are listed as pairs and the pairs confirmed. In a crowded
    region, where each row has dozens of candidates and a pair costs more than a row, the
    rows take their sets along into a second sweep that tests every candidate in place:
    a set then moves once a tree, however many candidates it has. Rows at the seams of
    partitions are treated alike.
    """
    pairs, crowd, crowded = _sweep(planted(nodes, forest, range(forest.trees)), forest, forest.window, _listed)
    # a row is put down once for every batch and seam that saw it
    crowd = materialize(crowd.distinct(), "forest-crowd")
    sets = set_table(crowd.select(F.col("cls").alias("doc_id")), docs, forest).withColumnRenamed("id", "cls")
    tested, _, _ = _sweep(crowd.join(sets.hint("merge"), "cls"), forest, forest.window, _tested)
    listed = confirmed(materialize(_pairs(pairs), "forest-pairs"), docs, forest)
    return listed.union(tested), crowded


def _checked(forest: Forest):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), forest) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    return check


def set_table(wanted: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """``id, x``: the shingle sets of the documents in ``wanted`` (``doc_id``); no other texts are cut into shingles."""
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.iloc[start : start + 500]
                yield pd.DataFrame({"id": batch["doc_id"], "x": [s.tobytes() for s in _sets_of(batch, forest.words)]})

    known = docs.select("doc_id", "text").join(wanted.distinct().hint("merge"), "doc_id", "left_semi").mapInPandas(sets, f"id {kind}, x binary")
    return materialize(known, "forest-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; only the texts of documents in pairs are read again."""
    kind = pairs.schema["a"].dataType.simpleString()
    known = set_table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, forest)
    first = known.withColumnRenamed("id", "a")
    second = known.select(F.col("id").alias("b"), F.col("x").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInPandas(_checked(forest), f"a {kind}, b {kind}").distinct()


def overflowing(crowded: DataFrame, groups: DataFrame, forest: Forest) -> DataFrame:
    """``cls, comp``: the rows of stretches of several components of which some row left the view. ``groups`` is ``cls, comp``."""
    rows = crowded.join(groups.hint("merge"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = materialize(rows, "forest-crowded")
    parts = rows.groupBy("tree", "label", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("tree", "label").agg(F.sum("c").alias("_n"), F.max("c").alias("most"), F.count(F.lit(1)).alias("comps"))
    # components have only grown since the sweep, so one that had too many rows in view then has them now
    over = sizes.where((F.col("comps") > 1) & ((F.col("_n") > forest.window) | (F.col("most") > forest.of_one)))
    return attach(rows, over.select("tree", "label"), ["tree", "label"], ["cls"]).select("cls", "comp").distinct()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many shingles of the sets fall to each counter."""
    total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    for batch in batches:
        for x in batch["x"]:
            total += 0 if not len(x) else np.bincount((np.frombuffer(x, dtype=np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
    full = np.flatnonzero(total)
    yield pd.DataFrame({"counter": full, "c": total[full]})


def _first_shingles(forest: Forest, weights: np.ndarray):
    """The rarest shingles of each set, as many as can hold the first one it shares with a linked set no larger than itself.

    ``weights``: a rough logarithm of each counter's count; 8 is a count of one. Any order
    that all sets share gives the same links; a rare one first gives few candidates.
    """
    h = forest.hundredths

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t, at, size, row = [], [], [], []
            for i, x in enumerate(batch["x"]):
                x = np.frombuffer(x, dtype=np.uint64)
                w = weights[(x >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                n = len(x)
                best = np.argsort(w, kind="stable")[: n - -(-h * n // 100) + 1]
                p = np.flatnonzero(w[best] > 8)
                t.append(x[best][p].view(np.int64))
                at.append(p)
                size.append(np.full(len(p), n))
                row.append(np.full(len(p), i))
            if t:
                some = batch.iloc[np.concatenate(row)]
                yield pd.DataFrame({"t": np.concatenate(t), "p": np.concatenate(at), "n": np.concatenate(size), "cls": some["cls"].to_numpy(), "comp": some["comp"].to_numpy()})

    return first


def rare_links(rows: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """All links between rows (``cls, comp``) of different components, by what their full sets share.

    Sets of m >= n shingles with a similarity of h hundredths share at least
    ``a = h (m + n) / (100 + h)``, and at the first one they share, in an order common to all,
    both have ``a`` or more left. So each pair meets in a shingle among the first
    ``m - h m / 100`` of the larger and the first ``n - 2 h n / (100 + h)`` of the smaller, and
    the places there rule out most pairs that are no link. Nothing is left to chance and
    no group of pairs is cut. Rows of the component that has most rows under a shingle
    are joined with rows of other components only; hot shingles are split over tasks.
    """
    spark, h = rows.sparkSession, forest.hundredths
    kind = rows.schema["cls"].dataType.simpleString()
    sets = set_table(rows.select(F.col("cls").alias("doc_id")), docs, forest).withColumnRenamed("id", "cls")
    counts = sets.select("x").mapInPandas(_counted, "counter int, c long").groupBy("counter").agg(F.sum("c").alias("c")).toPandas()
    weights = np.zeros(1 << COUNTER_BITS, dtype=np.uint16)
    weights[counts["counter"].to_numpy()] = 8 * np.log2(1 + counts["c"].to_numpy())
    shape = f"t long, p int, n int, cls {kind}, comp {kind}"
    first = sets.join(rows.hint("merge"), "cls").select("cls", "comp", "x").mapInPandas(_first_shingles(forest, weights), shape)
    first = materialize(first.withColumn("small", F.expr(f"{100 + h} * (n - p) >= {2 * h} * n")), "forest-first")
    under = first.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("small").alias("small"))
    under = under.groupBy("t").agg(F.sum("c").alias("_n"), F.count(F.lit(1)).alias("comps"), F.max("small").alias("any"), F.max(F.struct("c", "comp")).alias("top"))
    live = materialize(under.where("comps > 1 and any").select("t", "_n", F.col("top.comp").alias("top")), "forest-live")
    met = salted_join(first, live.select("t", "top"), ["t"], ["cls"], rows_per_salt=ROWS_PER_SALT, counts=live.select("t", "_n"))
    met = materialize(met.withColumn("major", F.col("comp") == F.col("top")).drop("top"), "forest-met")

    def as_(which: str, name: str) -> DataFrame:
        return met.where(which).select("t", *[F.col(c).alias(f"{name}{c}") for c in ("p", "n", "cls", "comp")])

    def joined(big: DataFrame, salt_on: str, small: DataFrame) -> DataFrame:
        both = salted_join(big, small, ["t"], [salt_on], rows_per_salt=ROWS_PER_SALT, counts=live.select("t", "_n"))
        both = both.where("x_comp <> y_comp and (x_n > y_n or (x_n = y_n and x_cls > y_cls))").where(f"100 * y_n >= {h} * x_n")
        both = both.where(f"{100 + h} * least(x_n - x_p, y_n - y_p) >= {h} * (x_n + y_n)")
        return both.select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"))

    pairs = joined(as_("small", "y_"), "y_cls", as_("not major", "x_")).union(joined(as_("major", "x_"), "x_cls", as_("small and not major", "y_")))
    return confirmed(materialize(_pairs(pairs), "forest-pairs"), docs, forest)


def near_groups(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with its group of near-duplicates.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row. Two documents
    are linked when ``100 * intersection >= hundredths * union`` of their sets of distinct
    shingles of ``words`` words (A-Z lower-cased; a shorter text is one shingle), tested on
    the full sets. ``component_id`` is the smallest ``doc_id`` that links reach.

    Documents with equal sets become one class first. A forest over the classes'
    signatures gives candidates: two documents of similarity 0.8 share the least depth in
    some tree but for a chance of three in a million. Where more rows than the window share
    that depth, a row sees the nearest ones, which is the region's own, greater depth.
    First a few trees with a narrow view find the bulk of the links; then all trees, where
    members of one component no longer count as neighbours, so its pairs are never listed.
    Rows of stretches in which a row left the view, by the window or because its component
    has many there, are joined once more by their rarest shingles (``rare_links``), which misses no link.

    A text without words (null too) has an empty set and is linked with nothing. Null ids
    keep their row: equal sets share a component, but they don't take part in links. Rows
    of one ``doc_id`` are one document. Long texts are used whole. Other columns are not
    looked at. An empty table gives no rows.
    """
    shape = "digest binary, n int, values binary, s0 long, s1 long"
    feats = materialize(map_rows(docs.select("doc_id", "text"), _features(forest), shape), "forest-features")
    # rows with one digest have one set, and so one signature
    classes = feats.where("digest is not null").groupBy("digest", "n", "values", "s0", "s1").agg(F.min("doc_id").alias("cls"))
    classes = materialize(classes, "forest-classes")
    nodes = classes.where("cls is not null").select("cls", F.col("cls").alias("comp"), "n", "values", "s0", "s1")
    links = materialize(bulk_links(nodes, docs, forest), "forest-links")
    groups = materialize(components(links), "forest-groups").withColumnRenamed("node", "cls")
    placed = nodes.drop("comp").join(groups, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    more, crowded = forest_links(placed, docs, forest)
    final = materialize(components(groups.select(F.col("cls").alias("a"), F.col("component").alias("b")).union(more)), "forest-groups")
    left = materialize(overflowing(crowded, final.select(F.col("node").alias("cls"), F.col("component").alias("comp")), forest), "forest-left")
    if not left.isEmpty():
        late = materialize(rare_links(left, docs, forest), "forest-links")
        if not late.isEmpty():
            final = components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))
    named = classes.select("digest", "cls").join(final.withColumnRenamed("node", "cls"), "cls", "left")
    facts = named.select("digest", F.coalesce("component", "cls").alias("_component"))
    lone = F.concat(F.encode(F.lit("lone "), "utf-8"), F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.lit(b"")))
    rows = feats.select("doc_id", "n", F.coalesce("digest", lone).alias("digest"))
    joined = attach(rows, facts, ["digest"], ["doc_id"], "left")
    component = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps, with all their columns."""
    kept = near_groups(docs, forest).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"))
    return rows.join(kept, rows["_key"].eqNullSafe(kept["_id"]), "left_semi").select("_row.*")
