"""Conversation structure repair: cheapest edits by a min-plus programme over runs of equal turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import attach, by_value
from emberlake.session import materialize

by_value(__name__)

BLANKS = " \t\n\x0b\x0c\r"
#: What stands before a place: nothing, a system turn, a user turn, an assistant turn.
STATES = range(4)
NEVER = 1 << 50
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: Turns as letters: ``x`` must go; the role's initial (``o``: none that fits), upper case where the text is unfinished.
SYMBOLS = "xsuaoSUAO"
#: Cost of the insertions that end a conversation well.
END = [0, 2 * INSERT, INSERT, 0]

Vector = list[int]
Matrix = list[list[int]]


def _next(state: int) -> int:
    """The state behind the one turn that may be inserted, or a turn be made into, there."""
    return 3 if state == 2 else 2


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """``(edit, state after, cost)`` for a turn, the least letter first; insertions come before it."""
    out = [("D", state, DELETE)]
    if symbol != "x":
        role, more = symbol.lower(), UNFINISHED * symbol.isupper()
        after = {"s": 1, "u": 2, "a": 3}.get(role)
        if after is not None and (state == 0 if role == "s" else after == _next(state)):
            out.append(("K", after, KEEP + more))
        out.append(("R", _next(state), REROLE + more))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [[min(row[k] + b[k][j] for k in STATES) for j in STATES] for row in a]


def applied(a: Matrix, v: Vector) -> Vector:
    return [min(x + y for x, y in zip(row, v, strict=True)) for row in a]


def _one(symbol: str) -> Matrix:
    """Least cost from the state before a turn to the one behind it, with up to two insertions before it."""
    out = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        at, paid = state, 0
        for _ in range(3):
            for _edit, after, cost in moves(symbol, at):
                out[state][after] = min(out[state][after], paid + cost)
            at, paid = _next(at), paid + INSERT
    return out


#: For each symbol the transitions of 1, 2, 4, ... such turns, as far as they were asked for.
_powers: dict[str, list[Matrix]] = {}


def power(symbol: str, k: int) -> Matrix:
    """The transition of ``2 ** k`` equal turns."""
    known = _powers.setdefault(symbol, [_one(symbol)])
    while len(known) <= k:
        known.append(times(known[-1], known[-1]))
    return known[k]


def behind_run(symbol: str, n: int, end: Vector) -> Vector:
    """Cost to go before a run of ``n`` equal turns, from that behind it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            end = applied(power(symbol, k), end)
    return end


def transition(runs: list[tuple[str, int]]) -> Matrix:
    """The transition of a piece of a conversation."""
    rows = [[0 if i == j else NEVER for i in STATES] for j in STATES]
    for symbol, n in reversed(runs):
        rows = [behind_run(symbol, n, column) for column in rows]
    return [[min(NEVER, rows[j][i]) for j in STATES] for i in STATES]


def _costs_behind(symbol: str, n: int, end: Vector) -> Iterator[Vector]:
    """Cost to go behind each of ``n`` equal turns, first to last; halving keeps only a few vectors at a time."""
    if n == 1:
        yield end
        return
    k = (n - 1).bit_length() - 1
    yield from _costs_behind(symbol, n - (1 << k), applied(power(symbol, k), end))
    yield from _costs_behind(symbol, 1 << k, end)


def unroll(runs: list[tuple[str, int]], state: int, end: Vector, last: bool) -> str:
    """The least in letters of the cheapest edits of a piece."""
    walk = []
    for symbol, n in reversed(runs):
        before = behind_run(symbol, n, end)
        walk.append((symbol, n, before, end))
        end = before
    out: list[str] = []
    for symbol, n, here, behind in reversed(walk):
        for after in _costs_behind(symbol, n, behind):
            while True:
                options = [(e, s, c + after[s]) for e, s, c in moves(symbol, state)]
                options.insert(1, ("I", _next(state), INSERT + here[_next(state)]))
                edit, state = next((e, s) for e, s, c in options if c == here[state])
                out.append(edit)
                if edit != "I":
                    break
            here = after
    while last and END[state]:
        out.append("I")
        state = _next(state)
    return "".join(out)


def _add(runs: list[tuple[str, int]], symbol: str, n: int) -> None:
    if n and runs and runs[-1][0] == symbol:
        runs[-1] = (symbol, runs[-1][1] + n)
    elif n:
        runs.append((symbol, n))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _written(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _fields(key: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", key), ("piece", pa.int64()), *more])


RUNS = ("runs", pa.list_(pa.struct([("symbol", pa.string()), ("n", pa.int64())])))
RUNS_DDL = "runs array<struct<symbol: string, n: long>>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns by conversation, piece and place -> a row per piece with its runs and transition."""

    def found(first: pa.RecordBatch) -> Iterator[dict]:
        now, runs = None, []

        def done() -> dict:
            conv, piece = now
            return {"conv_id": conv, "piece": piece, "runs": [{"symbol": s, "n": n} for s, n in runs], "costs": [x for row in transition(runs) for x in row]}

        for r in _records(_chain(first, batches)):
            if now != (r["conv_id"], r["piece"]):
                if now:
                    yield done()
                now, runs = (r["conv_id"], r["piece"]), []
            if r["copies"]:
                _add(runs, r["symbol"], 1)
                _add(runs, "x", r["copies"] - 1)
        yield done()

    for first in batches:
        if first.num_rows:
            key = first.schema.field("conv_id").type
            yield from _written(found(first), _fields(key, RUNS, ("costs", pa.list_(pa.int64()))))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _costs_to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by conversation, the last first -> each with the cost to go behind it, and if it is the first or last."""

    def found(first: pa.RecordBatch) -> Iterator[dict]:
        held = None
        for r in _records(_chain(first, batches)):
            last = held is None or held["conv_id"] != r["conv_id"]
            if held:
                yield held | {"first": last}
            if last:
                behind = END
            held = {"conv_id": r["conv_id"], "piece": r["piece"], "runs": r["runs"], "behind": behind, "last": last}
            costs = r["costs"]
            behind = applied([costs[4 * i : 4 * i + 4] for i in STATES], behind)
        if held:
            yield held | {"first": True}

    for first in batches:
        if first.num_rows:
            key = first.schema.field("conv_id").type
            yield from _written(found(first), _fields(key, RUNS, ("behind", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())))


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits, for every state before it that can be."""

    def found(batch: pa.RecordBatch) -> Iterator[dict]:
        for r in batch.to_pylist():
            runs = [(x["symbol"], x["n"]) for x in r["runs"]]
            edits = [unroll(runs, s, r["behind"], r["last"]) for s in ([0] if r["first"] else STATES)]
            yield {"conv_id": r["conv_id"], "piece": r["piece"], "edits": edits}

    for batch in batches:
        key = batch.schema.field("conv_id").type
        yield from _written(found(batch), _fields(key, ("edits", pa.list_(pa.string()))))


@dataclass
class _Conversation:
    """One conversation while its turns pass by in order."""

    conv_id: object
    lines: list[tuple[str, str]] | None = None
    state: int = 0
    facts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost"], 0))
    audit: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    said: int = 0
    initial: str | None = None
    turns: tuple[int, int, int] | None = None
    edits: str = ""
    at: int = 0

    def say(self, role: str, text: str) -> None:
        line = ("\n" if self.said else "") + role + ":" + text
        self.digest.update(line.encode("utf-8", "surrogatepass"))
        self.said += 1
        if self.lines is not None:
            self.lines.append((role, text))

    def insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = _next(self.state)
            self.facts["cost"] += INSERT
            self.say("user" if self.state == 2 else "assistant", "")

    def piece(self, edits: list[str]) -> None:
        """A piece begins; of its edits those for the state so far are taken."""
        self.edits, self.at = edits[self.state if len(edits) > 1 else 0], 0
        self.audit.append(self.edits)

    def turn(self, r: dict) -> None:
        for name in ("blank", "duplicate", "truncated"):
            self.facts[name] += r[name]
        initial = r["role"][:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.facts["illegal"] += 1
        self.facts["illegal"] += r["copies"] - 1
        self.initial = initial
        if (t := r["turn"]) is not None:
            low, high, n = self.turns or (t, t, 0)
            self.turns = (low, t, n + (n == 0 or t != high))
        symbol = r["symbol"]
        for _ in range(r["copies"]):
            self.insertions()
            edit = self.edits[self.at]
            self.at += 1
            after, cost = next((s, c) for e, s, c in moves(symbol, self.state) if e == edit)
            self.facts["cost"] += cost
            self.state = after
            if edit == "K":
                self.say(r["role"], r["text"])
            elif edit == "R":
                self.say("user" if after == 2 else "assistant", r["text"])
            symbol = "x"  # further copies are duplicates

    def done(self) -> dict:
        self.insertions()
        low, high, n = self.turns or (0, 0, 1)
        return {"conv_id": self.conv_id, "gaps": high - low + 1 - n, **self.facts, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _replay(lines: bool):
    """Turns and their pieces' edits, in order -> a row for each conversation, or one for each repaired turn."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(first: pa.RecordBatch) -> Iterator[dict]:
            now: _Conversation | None = None
            place = 0

            def spoken() -> Iterator[dict]:
                nonlocal place
                for role, text in now.lines:
                    yield {"conv_id": now.conv_id, "place": place, "role": role, "text": text}
                    place += 1
                now.lines.clear()

            for r in _records(_chain(first, batches)):
                if now is None or now.conv_id != r["conv_id"]:
                    if now:
                        summary = now.done()
                        yield from spoken() if lines else [summary]
                    now, place = _Conversation(r["conv_id"], [] if lines else None), 0
                if r["edits"] is not None:
                    now.piece(r["edits"])
                elif r["copies"]:
                    now.turn(r)
                if lines:
                    yield from spoken()
            if now:
                summary = now.done()
                yield from spoken() if lines else [summary]

        for first in batches:
            if first.num_rows:
                key = ("conv_id", first.schema.field("conv_id").type)
                kinds = {"audit": pa.string(), "repaired_sha256": pa.string()}
                names = ["place", "role", "text"] if lines else ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
                kinds |= {"role": pa.string(), "text": pa.string()}
                yield from _written(found(first), pa.schema([key, *[(n, kinds.get(n, pa.int64())) for n in names]]))

    return replay


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (``conv_id``, ``turn``, ``role``, ``text``) with reproducible faults, and ``copies`` of each row (0: dropped).

    By the crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1), loses its
    ends of sentences (2), is repeated (3) or becomes the user's (4). Nulls count as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def _symbol(first: Column, last: Column) -> Column:
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(~first | (last == ""), "x").when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter))


def in_order(turns: DataFrame, copies: str | None = None, pieces: int | None = None) -> DataFrame:
    """The turns with their faults, symbols and places, cut into pieces that tasks can hold; written.

    Equal turns are combined to one row with ``copies``. A conversation that is longer than a
    partition lies in several pieces, in order. Turns of one number are ordered by a digest of
    role and text.
    """
    shown = lambda c: F.coalesce(F.col(c), F.lit(" "))
    often = F.coalesce(F.greatest(F.col(copies), F.lit(0)), F.lit(0)) if copies else F.lit(1)
    there = often > 0
    rows = turns.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, shown("role")).alias("role"), F.when(there, shown("text")).alias("text"), often.alias("copies"),
    )
    # dropped turns become one empty row, so that their conversation stays known
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text").cast("binary"), 256)
    rows = rows.withColumn("_tie", F.coalesce(digest, F.lit("")))
    # null-safe keys
    rows = rows.withColumns({"_known": F.col("conv_id").isNotNull(), "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    first = rows.groupBy("_known", "_conv", "_tie").agg(F.min(F.struct("turn")).alias("_first"))
    rows = attach(rows, first, ["_known", "_conv", "_tie"], ["turn"])
    last = F.coalesce(F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1)), F.lit(""))
    new, copies = F.col("_first")["turn"].eqNullSafe(F.col("turn")), F.col("copies")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "_tie", new.alias("new"), last.alias("last"))
    new, last = F.col("new"), F.col("last")
    rows = rows.select(
        "conv_id", "turn", "_tie", "role", "text", "copies", _symbol(new, last).alias("symbol"),
        F.when(last == "", copies).otherwise(0).alias("blank"), F.when(last == "", 0).otherwise(copies - new.cast("long")).alias("duplicate"),
        (new & (last != "") & ~last.isin(".", "!", "?")).cast("long").alias("truncated"),
    )
    order = ["conv_id", "turn", "_tie"]
    dealt = rows.repartitionByRange(*([pieces] if pieces else []), *order).sortWithinPartitions(*order).drop("_tie")
    # the id numbers a partition's rows in order, behind the partition's own number
    return materialize(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("at", 33)), "conversation-turns")


def _edits_and_turns(turns: DataFrame, copies: str | None, pieces: int | None) -> DataFrame:
    rows = in_order(turns, copies, pieces)
    # symbols are few bytes but real work: as many tasks as the session shuffles to, not as bytes would make
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    sorted_rows = rows.select("conv_id", "piece", "at", "symbol", "copies").repartition(tasks, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")
    cut = sorted_rows.mapInArrow(_pieces, f"{key}, piece long, {RUNS_DDL}, costs array<long>")
    costs = cut.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(_costs_to_go, f"{key}, piece long, {RUNS_DDL}, behind array<long>, first boolean, last boolean")
    chosen = costs.repartition(tasks, "conv_id", "piece").mapInArrow(_choices, f"{key}, piece long, edits array<string>")
    both = rows.unionByName(chosen, allowMissingColumns=True)  # a piece's edits have no place, so they come before its turns
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at")


def repaired(turns: DataFrame, copies: str | None = None, pieces: int | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``): its faults, cheapest edits and a digest of the result.

    ``gaps, blank, duplicate, truncated, illegal`` count the faults, ``cost`` and ``audit`` are the
    cheapest edits (Keep, Rerole, Delete, Insert) that leave an optional system turn and then
    user and assistant in turn; of equally cheap ones the least in letters. The column
    named by ``copies``, if any, says how often a row stands there; with 0 only its conversation counts. Null roles and texts are
    one space, null turns come first, the null conversation is one of its own, roles of other
    initials can't be kept as they are. Other columns are not looked at. An empty table gives no rows.

    A long conversation is cut into pieces (``pieces`` in all, else by size): transitions and choices
    are worked out piece by piece, and only 16 numbers a piece meet in order. The digest and the
    audit, one value each, are written by one task that the turns pass through in order and that holds none of them.
    """
    both = _edits_and_turns(turns, copies, pieces)
    return both.mapInArrow(_replay(False), f"conv_id {both.schema['conv_id'].dataType.simpleString()}, {SUMMARY}")


def repaired_turns(turns: DataFrame, copies: str | None = None, pieces: int | None = None) -> DataFrame:
    """The turns that ``repaired`` leaves: ``conv_id, place, role, text``, ``place`` from 0."""
    both = _edits_and_turns(turns, copies, pieces)
    return both.mapInArrow(_replay(True), f"conv_id {both.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")
