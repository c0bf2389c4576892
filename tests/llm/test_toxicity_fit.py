"""The toxicity model is fitted on the keys of telling features; the others stay with the executors."""

import random

import numpy as np

from emberlake.llm import mil_toxicity as MT

S = MT.Settings(rounds=5, batch=40)


def _rows():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            words.append(rng.choice(["vileness", "vileful"]))
        rows.append((i, " ".join(words).replace("w7 ", "w7. ")))
        labels.append((i, int(toxic)))
    rows += [(i + 1000, rows[i][1]) for i in range(60)] + [(2000, None), (2001, "")]  # copies, null and empty texts
    labels += [(i + 1000, labels[i][1]) for i in range(60)] + [(2000, 0), (2001, 1)]
    return rows, labels


def _plain(rows, labels):
    """The rows of the model as the driver would choose them from all keys."""
    import pandas as pd
    import zlib

    marked = dict(labels)
    open_ = [(marked[d], t) for d, t in rows if zlib.crc32(str(d).encode()) % 5]
    got = next(MT._extract(S)(iter([pd.DataFrame(open_, columns=["toxic", "text"])])))
    pairs = sorted(zip(got["toxic"], got["words"]))
    keys = [(y, np.frombuffer(b, dtype=np.uint32)) for y, b in pairs]
    seen, bad = np.zeros(S.bins), np.zeros(S.bins)
    for y, k in keys:
        found = np.unique(k % S.bins)
        seen[found] += 1
        bad[found] += y
    share = sum(y for y, _ in keys) / len(keys)
    kept = (seen >= S.least) & (bad - share * seen > S.signal * np.sqrt(seen * share * (1 - share)))
    return [(y, k[kept[k % S.bins]]) for y, k in keys], sum(len(k) for _, k in keys)


def test_driver_gets_telling_keys_only_and_the_same_model(spark, monkeypatch):
    rows, labels = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    given, fit_rows = [], MT.fit_rows
    monkeypatch.setattr(MT, "fit_rows", lambda r, s: given.append(r) or fit_rows(r, s))
    model = MT.fit(docs, marks, S)
    want, all_keys = _plain(rows, labels)
    assert [(y, k.tolist()) for y, k in given[0]] == [(y, k.tolist()) for y, k in want]
    assert 0 < sum(len(k) for _, k in given[0]) < all_keys / 5
    plain = fit_rows(want, S)
    assert np.array_equal(model.weights, plain.weights) and model.bias == plain.bias


def test_without_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = MT.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), S)
    assert not model.weights.any() and model.bias == S.start
