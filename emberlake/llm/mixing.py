"""Mixing sources to target weights: blocks of words drawn per shard and joined by index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import WORD, by_value
from emberlake.session import materialize

by_value(__name__)


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources in order of their code points, repeating
    most: int = 3  # times its size that a source may be taken
    block_words: int = 256
    shard_slots: int = 4096
    most_shards: int = 65_536  # beyond, shards get more slots
    task_slots: int = 1 << 20  # slots that one task makes, about
    seed: int = 7


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source, source_size, target`` per source of ``sized`` (``source``, ``size``).

    The sources share the sum of all sizes by weight. A source's target stops at ``most``
    times its size, and the excess is shared anew by weight until none is above. Done at
    once: in order of limit by weight, the sources that stop are those whose limit by
    weight is below the level at which the rest would share what is left. One row per
    source passes through the windows.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(w) for w in mix.weights])[((F.row_number().over(by_name) - 1) % len(mix.weights)).cast("int")]
    rows = sums.withColumn("_w", weight).withColumn("_limit", F.lit(mix.most) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    open_ = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = rows.withColumn("_level", left / open_)
    stops = F.col("_limit") / F.col("_w") <= F.col("_level")
    # the first source that doesn't stop sets the level of all that follow
    first = F.first(F.when(~stops, F.col("_level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    goal = F.when(first.isNull(), F.col("_limit").cast("double")).otherwise(F.col("_w") * first)
    return level.select("source", "source_size", goal.alias("target"))


def shuffled(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places ``at``: a keyed Feistel network, walked until it falls below n."""
    if n <= 1:
        return at.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence([key & 0xFFFFFFFFFFFFFFFF]).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(at.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    return int(np.random.SeedSequence([p & 0xFFFFFFFF for p in parts]).generate_state(1, np.uint64)[0])


def plan_of(goals: list, mix: Mix) -> dict[str, np.ndarray]:
    """What each source gives, in blocks and slots; ``goals`` are the rows of ``targets`` in order of the source."""
    size = np.array([r["source_size"] or 0 for r in goals], dtype=np.int64)
    want = np.minimum(np.array([np.floor((r["target"] or 0) + 1e-6) for r in goals], dtype=np.int64), mix.most * size)
    full, tail = size // mix.block_words, size % mix.block_words
    blocks = full + (tail > 0)
    epochs = np.where(size > 0, want // np.maximum(size, 1), 0)
    rest = want - epochs * size
    slots = epochs * blocks + rest // mix.block_words + (rest % mix.block_words > 0)
    return {"full": full, "tail": tail, "blocks": blocks, "epochs": epochs, "rest": rest, "slots": slots}


def draw_slots(spark, plan: dict[str, np.ndarray], mix: Mix) -> DataFrame:
    """The slots of all shards: ``shard, slot, rank, epoch, block, words``.

    Each shard draws how many slots each source gets from a multinomial with the sources'
    shares of all slots. The draws of a source are numbered through the shards; those above
    its share go, by their number, to the sources that fell short, so that every source has
    exactly its slots. Slot j of a source is place j of its blocks: a fresh permutation in
    each pass over the source, the short last block closing the pass. The very last slot
    takes only the words still wanted.
    """
    slots = plan["slots"]
    total = int(slots.sum())
    size = max(mix.shard_slots, -(-total // mix.most_shards))
    shards = -(-total // size)
    share = slots / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(size, total - int(shard) * size)
                drawn = np.random.default_rng([mix.seed, int(shard)]).multinomial(n, share)
                ranks = np.flatnonzero(drawn)
                start = np.cumsum(drawn) - drawn
                yield pd.DataFrame({"shard": shard, "rank": ranks, "taken": drawn[ranks], "at": start[ranks], "n": n})

    spread = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4)))
    drawn = materialize(spread.mapInPandas(draw, "shard long, rank int, taken long, at long, n long"), "mix-draws")
    counted = {r["rank"]: r["n"] for r in drawn.groupBy("rank").agg(F.sum("taken").alias("n")).collect()}  # one row per source
    got = np.array([counted.get(i, 0) for i in range(len(slots))], dtype=np.int64)
    over, short = np.maximum(got - slots, 0), np.maximum(slots - got, 0)
    over_start = np.cumsum(over) - over
    short_end = np.cumsum(short)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                j = np.arange(r.before, r.before + r.taken)
                ranks = np.full(len(j), r.rank)
                if len(j) and j[-1] >= slots[r.rank]:
                    extra = np.flatnonzero(j >= slots[r.rank])
                    number = over_start[r.rank] + j[extra] - slots[r.rank]
                    to = np.searchsorted(short_end, number, side="right")
                    ranks[extra] = to
                    j[extra] = got[to] + number - (short_end[to] - short[to])
                block, words, epoch = np.empty_like(j), np.empty_like(j), np.empty_like(j)
                for rank in np.unique(ranks):
                    mine = ranks == rank
                    epoch[mine] = j[mine] // plan["blocks"][rank]
                    index = j[mine] % plan["blocks"][rank]
                    full, b = plan["full"][rank], index.copy()
                    for e in np.unique(epoch[mine]):
                        here = (epoch[mine] == e) & (index < full)
                        b[here] = shuffled(index[here], int(full), _key(mix.seed, rank, e))
                    block[mine] = b
                    words[mine] = np.where(b < full, mix.block_words, plan["tail"][rank])
                    last = (j[mine] == slots[rank] - 1) & (plan["rest"][rank] % mix.block_words > 0)
                    words[mine] = np.where(last, plan["rest"][rank] % mix.block_words, words[mine])
                slot = shuffled(np.arange(r.at, r.at + r.taken), int(r.n), _key(mix.seed, r.shard))
                yield pd.DataFrame({"shard": r.shard, "slot": slot, "rank": ranks, "epoch": epoch, "block": block, "words": words})

    before = F.coalesce(F.sum("taken").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows per source as there are shards, at most most_shards; few bytes each, but all slots are made from them
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // mix.task_slots))
    runs = drawn.withColumn("before", before).repartition(min(tasks, max(1, shards)), "shard")
    return runs.mapInPandas(place, "shard long, slot long, rank int, epoch long, block long, words long")


@dataclass
class Plan:
    placed: DataFrame  # doc_id, source, size, mark, rank, at: where each document's words begin in its source
    slots: DataFrame
    goals: DataFrame  # rank, source, source_size, target
    epochs: np.ndarray


def plan_mix(docs: DataFrame, mix: Mix = Mix()) -> Plan:
    """Lay the words of ``docs`` (``doc_id``, ``source``, ``text``) out by source and draw the slots of the mix.

    Within a source the documents follow each other in a pseudorandom order (by a hash of
    id and text, cut into sections whose number is the root of the number of rows; windows
    run inside a section and over the sections' sums).
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"))
    sized = materialize(sized, "mix-sizes")
    goals = targets(sized, mix).orderBy(F.col("source").asc_nulls_last()).collect()  # one row per source
    plan = plan_of(goals, mix)
    ranked = [(i, r["source"], int(r["source_size"] or 0), float(r["target"] or 0)) for i, r in enumerate(goals)]
    named = spark.createDataFrame(ranked, f"rank int, source {sized.schema['source'].dataType.simpleString()}, source_size long, target double")

    sections = max(1, int(np.sqrt(sized.count())))
    cut = sized.withColumn("_part", F.pmod("mark", F.lit(sections)))
    earlier = Window.unboundedPreceding, -1
    sums = cut.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_part").rowsBetween(*earlier)), F.lit(0))
    inside = Window.partitionBy("source", "_part").orderBy("mark", "doc_id", "size").rowsBetween(*earlier)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), base.alias("_base"))
    run = cut.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = run.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    placed = placed.join(F.broadcast(named.select("rank", F.col("source").alias("_name"))), F.col("source").eqNullSafe(F.col("_name")))  # one row per source
    placed = placed.select("doc_id", "source", "size", "mark", "rank", (F.col("_base") + F.col("_run")).alias("at"))
    slots = materialize(draw_slots(spark, plan, mix), "mix-slots")
    return Plan(materialize(placed, "mix-placed"), slots, named, plan["epochs"])


def _pieces(plan: Plan, mix: Mix, *more: str) -> DataFrame:
    """Each document's part of each block: ``lo`` to ``hi`` are words of the block, ``from`` is the part's first word in the document."""
    b = F.lit(mix.block_words)
    some = plan.placed.where("size > 0").withColumn("_end", F.col("at") + F.col("size"))
    each = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("_end") - 1) / b))))
    lo = F.greatest(F.col("at") - F.col("block") * b, F.lit(0))
    hi = F.least(F.col("_end") - F.col("block") * b, b)
    return each.select("doc_id", "source", "size", "mark", "rank", "at", "block", lo.alias("lo"), hi.alias("hi"), (F.col("block") * b + lo - F.col("at")).alias("from"), *more)


def mixed_sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """How much of each row of ``docs`` (``doc_id``, ``source``, ``text``) the mix takes.

    Returns ``doc_id, size, source_size, target, taken``, one row per input row: words of the
    text (null: 0), of all its source, the source's target, and the words of this row that
    the mix takes, repeats counted. The taken words of a source are its target rounded
    down, and no row is taken more than ``most`` times. Null is a source of its own, after
    all others. Repeated rows follow each other and are taken one by one; null ids are kept;
    texts longer than a block take part in many; other columns are not looked at; an empty
    table gives no rows. The seed and the rows decide the result, not their order.
    """
    plan = plan_mix(docs, mix)
    part = F.col("words") < F.least(F.lit(mix.block_words), F.col("_full"))
    known = plan.slots.join(F.broadcast(plan.goals.select("rank", F.col("source_size").alias("_all"))), "rank")  # one row per source
    known = known.withColumn("_full", F.least(F.lit(mix.block_words), F.col("_all") - F.col("block") * mix.block_words))
    uses = known.groupBy("rank", "block").agg(F.count(F.when(~part, 1)).alias("uses"), F.max(F.when(part, F.col("words"))).alias("part"))
    took = F.col("uses") * (F.col("hi") - F.col("lo")) + F.greatest(F.least(F.col("hi"), F.coalesce("part", F.lit(0))) - F.col("lo"), F.lit(0))
    taken = _pieces(plan, mix).join(uses, ["rank", "block"], "left").groupBy("doc_id", "rank", "size", "at").agg(F.sum(F.coalesce(took, F.lit(0))).alias("taken"))
    none = plan.placed.where("size = 0").select("doc_id", "rank", "size", "at", F.lit(0).cast("bigint").alias("taken"))
    return taken.union(none).join(F.broadcast(plan.goals), "rank").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for every pass of the mix over a document.

    A pass that takes the whole document keeps its text; one that takes parts has the words
    of its parts, in order, joined by a space. ``n_chars``, where there is one, follows the
    text. Documents of which nothing is taken, as those without words, are not in the mix.
    """
    plan = plan_mix(docs, mix)
    got = _pieces(plan, mix).join(plan.slots.select("rank", "block", "epoch", "words"), ["rank", "block"])
    cut = got.withColumn("_n", F.least("hi", "words") - F.col("lo")).where("_n > 0")
    # as many parts as the document has blocks
    row = F.struct(F.col("from").alias("from"), F.col("_n").alias("n"))
    passes = cut.groupBy("doc_id", "mark", "size", "at", "epoch").agg(F.sort_array(F.collect_list(row)).alias("_parts"), F.sum("_n").alias("_words"))
    passes = passes.select(F.col("mark").alias("_mark"), F.col("size").alias("_size"), "_parts", "_words")
    # all columns travel in one, so none can clash with those made here
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_mark"))
    # rows that are equal in id and text are one row here; each has its own passes
    once = F.row_number().over(Window.partitionBy("_mark").orderBy(F.lit(0)))
    single = keyed.withColumn("_nth", once).where("_nth = 1")
    whole = F.col("_row.text")
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    parts = F.transform("_parts", lambda p: F.array_join(F.slice(words, (p["from"] + 1).cast("int"), p["n"].cast("int")), " "))
    text = F.when(F.col("_words") == F.col("_size"), whole).otherwise(F.array_join(parts, " "))
    out = single.join(passes, "_mark").select("_row", text.alias("_text"))
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def packed_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The packed output: ``shard, slot, source, text``, each text the words of one block; blocks are joined by index."""
    plan = plan_mix(docs, mix)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("mark"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words")).dropDuplicates(["mark"])
    words = F.slice("_words", (F.col("from") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    pieces = _pieces(plan, mix).join(keyed, "mark").select("rank", "block", F.struct(F.col("lo").alias("lo"), words.alias("w")).alias("p"))
    # a block has block_words words, so no more pieces than that
    texts = pieces.groupBy("rank", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"])).alias("_all"))
    out = plan.slots.join(texts, ["rank", "block"]).join(F.broadcast(plan.goals.select("rank", "source")), "rank")
    return out.select("shard", "slot", "source", F.array_join(F.slice("_all", F.lit(1), F.col("words").cast("int")), " ").alias("text"))
