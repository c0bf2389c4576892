"""Ids beyond 2^53 beside null ones, samples at any size, cutoffs in fixed order."""

import pytest
from pyspark.sql import functions as F

from emberlake.llm import lsh_forest, mil_toxicity, piece_chunks, pu_quality, risk_rules
from emberlake.llm.common import least_hash

tokens = pytest.importorskip("public_tokenizers")
BIG = 2**60
IDS = [None, BIG + 1, BIG + 3, None, -(2**62) - 1, 7]


def docs(spark):
    rows = [(d, f"some text number {i} " * 12, "en", "s", 1) for i, d in enumerate(IDS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumn("other", F.when(F.col("doc_id") > 7, F.col("doc_id"))).coalesce(1)


def labels(spark):
    return spark.createDataFrame([(BIG + 1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=str)


def test_ids_pass_through_python_as_they_are(spark):
    frame, want = docs(spark), sorted(IDS, key=str)
    assert ids(pu_quality.scored_quality(frame, labels(spark))) == want
    assert ids(mil_toxicity.scored_toxicity(frame, labels(spark))) == want
    assert ids(piece_chunks.encode_digests(frame, tokens.path("piece_bpe_32k.model"))) == want
    assert ids(piece_chunks.decode(piece_chunks.encode(frame, tokens.path("piece_bpe_32k.model")), tokens.path("piece_bpe_32k.model"))) == want
    assert ids(risk_rules.judged(frame, labels(spark))) == want
    groups = lsh_forest.near_groups(frame, lsh_forest.Forest(words=2)).collect()
    assert sorted((r.doc_id for r in groups), key=str) == want
    assert {r.component_id for r in groups} <= set(IDS)
    clean = mil_toxicity.clean_documents(frame, labels(spark), cut=2.0)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("rows", [10, 10**6, 10**13, 2**62])
def test_a_sample_is_never_empty_by_rounding(rows):
    bound = 5
    assert least_hash(rows, bound) + 2**63 == bound * 2**64 // rows > 0


def test_cutoffs_are_taken_in_a_fixed_order(spark):
    risk = risk_rules.Risk(share=0.1, cutoffs={"symbols": (0.1, 0.5), "upper": (0.2,)})
    assert risk_rules.steps_of(risk) == [("symbols", 1), ("upper", 0), ("symbols", 0)]
    # 300 good documents: 3 have many symbols (step 0), 30 some (step 2)
    rows = [("a", 10, 100, 90 if i < 3 else 30 if i < 33 else 0, 0, 0, 1, 0) for i in range(300)] + [("b", 10, 100, 0, 0, 0, 1, 0)] * 5
    names = "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
    got = {r.stratum: r.cuts for r in risk_rules.choose_cutoffs(spark.createDataFrame(rows, names), risk).collect()}
    assert risk_rules.below(3, 300, 0.1) <= 0.025 < risk_rules.below(33, 300, 0.1)
    assert got == {"a": {"symbols": 0.5, "upper": 0.2}, "b": {}}  # five documents can't certify anything
