"""Every stage of the pipeline, and run(), against plain loops on documents with planted copies, near copies and toxic texts."""

import hashlib
import random
import re

import pytest

tokens = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, n=5):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def one_of_equal(rows):
    """The ids that stay: of equal texts the smallest."""
    best = {}
    for doc_id, text in rows:
        key = SPACES.sub(" ", text or "")
        best[key] = min(best.get(key, doc_id), doc_id)
    return set(best.values())


def one_of_near(rows):
    """The ids that stay: the smallest of each group that links of similarity 0.8 join."""
    sets, root = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d for d in root if top(d) == d}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))
    rows, labels = [], []
    for i in range(150):
        rows.append((i, text(rng.randrange(20, 120))))
    for i in range(150, 270):  # a toxic sentence among others
        rows.append((i, text(30) + " . you vile scumtoad filth . " + text(20)))
    for i in range(300, 330):  # exact copies but for white space, and near ones
        rows.append((i, rows[i - 300][1].replace(" ", "  ")))
    for i in range(330, 360):
        words = rows[i - 320][1].split(" ")
        words[len(words) // 2 :] = [*words[len(words) // 2 :], f"extra{i}"]
        rows.append((i, " ".join(words)))
    rows += [(400, ""), (401, None), (402, " \n "), (2**60 + 1, text(50)), (2**60 + 3, text(50))]
    labels = [(i, 1, int(150 <= i < 270)) for i in range(270) if i % 3]
    where = str(tmp_path_factory.mktemp("corpus"))
    full = [(d, t, "en", f"s{d % 4}", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_and_run_equal_plain_loops(spark, folder):
    import corpus_pipeline
    import sentencepiece
    from emberlake.llm import mil_toxicity
    from emberlake.session import materialize

    stages = dict(corpus_pipeline.STAGES)
    first = spark.read.parquet(f"{folder}/documents.parquet")
    source = {r.doc_id: tuple(r) for r in first.collect()}

    docs = materialize(stages["toxicity"](spark, first, folder), "t")
    calm = {r.doc_id for r in mil_toxicity.scored_toxicity(first, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 0").collect()}
    kept = {r.doc_id: tuple(r) for r in docs.collect()}
    assert set(kept) == calm and all(source[d] == r for d, r in kept.items())
    assert not calm & set(range(150, 270)) and calm >= {*range(150), 400, 401, 402, 2**60 + 1, 2**60 + 3}

    for name, plain in (("exact dedup", one_of_equal), ("near dedup", one_of_near)):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialize(stages[name](spark, docs, folder), "t")
        kept = {r.doc_id: tuple(r) for r in docs.collect()}
        assert set(kept) == plain(before) and all(source[d] == r for d, r in kept.items()), name
        assert len(kept) < len(before)

    before = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    docs = materialize(stages["source mix"](spark, docs, folder), "t")
    mixed = docs.collect()
    taken = {}
    for r in mixed:
        words = WORD.findall(r.text)
        at = iter(before[r.doc_id])  # a pass has words of its document, in order
        assert words and all(w in at for w in words)
        assert (r.lang, r.source, r.n_chars) == (*source[r.doc_id][2:4], len(r.text))
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words)
    assert all(n <= 3 * len(before[d]) for d, n in taken.items())

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.path("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in mixed:
        ids = sp.encode(r.text)
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))))
    got = sorted(map(tuple, stages["tokens"](spark, docs, folder).collect()))
    assert got == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == got
