import hashlib
import random
import tracemalloc

import pytest

from emberlake.llm import piece_chunks

tokens = pytest.importorskip("public_tokenizers")


def test_table_stays_within_its_bound_and_keeps_its_block(monkeypatch):
    import sentencepiece

    model = tokens.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    monkeypatch.setattr(piece_chunks, "MOST_CHUNKS", 60)
    monkeypatch.setattr(piece_chunks, "FILL", 7, raising=False)
    rng, blocks = random.Random(5), []
    for _ in range(40):
        blocks.append(["".join(rng.choice("ab  ▁\né語🙂1.\x00ﬁ") for _ in range(rng.randrange(30))) for _ in range(4)])
    cut = [[piece_chunks.marked(t) for t in texts] for texts in blocks]
    assert max(len({c for cs in chunks for c in cs}) for chunks in cut) <= 60
    table, held = piece_chunks.ChunkTable(model), []
    for chunks in cut:
        table.fill(chunks)
        held.append(len(table.known))
    assert max(held) <= 60
    for texts, chunks in zip(blocks, cut):
        table.fill(chunks)
        for text, cs in zip(texts, chunks):
            ids = sp.encode(text)
            want = len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids)))
            assert piece_chunks._digests(table, cs) == want


def test_entry_is_lean():
    table = piece_chunks.ChunkTable(tokens.path("piece_bpe_32k.model"))
    chunks = [f"{piece_chunks.MARK}word{i}" for i in range(50_000)]
    tracemalloc.start()
    try:
        table.fill([chunks])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(table.known) == 50_000 and held < 190 * 50_000  # the chunks themselves were there before
