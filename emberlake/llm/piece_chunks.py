"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from emberlake.llm.common import by_value, map_rows

by_value(__name__)

MARK = "▁"
#: Markers and the word behind them: where a chunk ends, no piece goes on.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of text that are chunked together, distinct chunks that a task keeps from block to block, and chunks segmented at once.
BLOCK_CHARS = 500_000
MOST_CHUNKS = 300_000
FILL = 20_000


def marked(text: str | None) -> list[str]:
    """The chunks of a text, with a marker before it and one for each space."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def check_model(model: str) -> None:
    """The model's pieces must not cross a marker, and it must keep every space; else chunks can't be encoded apart."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross a marker: {crossing[:3]}")
    if sp.decode(sp.encode("  a  b ")) != "  a  b ":
        raise ValueError("the model doesn't keep its spaces")


class ChunkTable:
    """Distinct chunks and what they are segmented into; ``fill`` segments those that are new, each once.

    A worker keeps up to ``MOST_CHUNKS`` of them beside the JVM, so an entry is one text: the ids joined by
    commas. Most chunks are decoded to themselves; the others' decoded texts are in ``told``.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known: dict[str, str] = {}
        self.told: dict[str, str] = {}

    def fill(self, texts: list[list[str]]) -> None:
        """Take in the chunks of a block; the block's own are all held afterwards."""
        block = {c for t in texts for c in t}
        new = list(block - self.known.keys())
        if len(self.known) + len(new) > MOST_CHUNKS:
            self.known.clear()
            self.told.clear()
            new = list(block)
        for i in range(0, len(new), FILL):
            part = new[i : i + FILL]
            # the encoder puts one marker before a text by itself, and gives nothing for an empty one
            ids = [[self.sp.piece_to_id(MARK)] if c == MARK else x for c, x in zip(part, self.sp.encode([c[1:] for c in part], num_threads=1), strict=True)]
            for chunk, x, text in zip(part, ids, self.sp.decode(ids, num_threads=1), strict=True):
                self.known[chunk] = ",".join(map(str, x))
                if " " + text != chunk.replace(MARK, " "):
                    self.told[chunk] = " " + text

    def ids(self, chunks: list[str]) -> str:
        """The ids of a text, joined by commas; each chunk's in the order of the text."""
        return ",".join([self.known[c] for c in chunks])

    def decoded(self, chunks: list[str]) -> str:
        """The text decoded from those ids; decoding drops the first marker, that stands for no space."""
        return "".join([self.told.get(c, c) for c in chunks]).replace(MARK, " ")[1:]


def _per_text(docs: DataFrame, model: str, row, names: list[str], outputs: str) -> DataFrame:
    check_model(model)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(model)
        for batch in batches:
            at, size = 0, 0
            texts = batch["text"].tolist()
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= BLOCK_CHARS or i == len(texts) - 1:
                    chunks = [marked(t) for t in texts[at : i + 1]]
                    table.fill(chunks)
                    rows = [row(table, cs) for cs in chunks]
                    yield pd.DataFrame([(d, *r) for d, r in zip(ids[at : i + 1], rows, strict=True)], columns=["doc_id", *names])
                    at, size = i + 1, 0

    return map_rows(docs.select("doc_id", "text"), run, outputs)


def _digests(table: ChunkTable, chunks: list[str]) -> tuple[int, str, str]:
    ids = table.ids(chunks)
    n = ids.count(",") + 1 if ids else 0
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(table.decoded(chunks).encode()).hexdigest()


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """Token counts and digests of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``: all ids joined by commas, and
    the text decoded from them, both as lower-case hex of SHA-256.

    Texts are cut into chunks (markers and the word behind them), about half a million characters
    at a time. The distinct chunks that the task's table lacks are segmented, each once,
    and every text is put together from the table by position. The table starts anew before
    it grows over ``MOST_CHUNKS``, by which a worker's memory is bounded; nothing is shuffled, so neither a frequent chunk nor
    a repeated document makes a large group.

    A null or empty text has no ids; null and repeated ``doc_id`` keep their rows; a text
    longer than a block is a block by itself; other columns are not looked at; an empty
    table gives no rows. ``model`` is a path that every worker can read.
    """
    return _per_text(docs, model, _digests, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``, like ``encode_digests``."""
    return _per_text(docs, model, lambda table, chunks: ([int(i) for i in table.ids(chunks).split(",")] if chunks else [],), ["ids"], "ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id, ids``; null ids give an empty text."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [sp.decode([int(i) for i in ids]) if ids is not None else "" for ids in batch["ids"]]})

    return map_rows(encoded.select("doc_id", "ids"), texts, "text string")
