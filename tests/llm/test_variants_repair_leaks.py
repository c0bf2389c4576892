"""Spelling variants, conversation repair and decontamination against plain loops."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import pytest

from emberlake.llm import conversation, decontaminate, spelling

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")
DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 2**60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_queries_equal_their_sql():
    names = ["op11_", "op12_", "op13_"]
    done = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "compare.py"), DATA, *names], capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout


# spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_equal_all_pairs_tested(spark):
    rng = random.Random(5)
    words = {"", "ab"}
    while len(words) < 300:
        w = "".join(rng.choice("abÿ") for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 62, 63, 64, 65, 66])))
        i = rng.randrange(len(w))
        words |= {w, rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :]])}
    n = {w: rng.choice([2, 3, 20, 30, 200, 2000, 20_000]) for w in words}
    form, near = {}, {}
    for w in words:
        others = [v for v in words if one_edit(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        near[w], form[w] = len(others), best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    frame = spark.createDataFrame([*n.items(), (None, 4), ("no\0mark", 5)], "word string, n long").selectExpr("*", "1 as name", "'q' as key")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}
    assert got.pop(None) == (None, None, 4, 0, None) and got.pop("no\0mark") == (None, "no\0mark", 5, 0, None)
    assert got == {w: (form[w], root(w), n[w], near[w], n.get(form[w])) for w in words}
    assert spelling.variants(frame.limit(0)).count() == 0


def test_word_counts_lower_ascii_only_and_lose_a_letter(spark):
    texts = [(1, "Straßen ÄÖÜäöüß×÷ Straßen STRAßEN x9Kurzeda"), (BIG + 1, "Straßen " * 100), (None, "Straßen, straßen"), (2, None), (3, ""), (4, "a" * 7 + "\U0001f600" + "b" * 40_000)]
    want = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n")
    got = {r.word: r.n for r in spelling.word_counts(docs, occurrences=1, misspelt=3).collect()}
    assert got == {w: k for w, k in want.items() if len(w) >= 7}


# conversation repair


def cheapest(turns):
    """``(cost, audit)`` by trying all edits, state by state; ``turns`` are ``(initial, must go, unfinished)``."""
    best = {0: (0, "")}
    for initial, gone, unfinished in turns:
        best = _inserted(best)
        new = {}
        for q, (c, a) in best.items():
            options = [(q, c + 2, a + "D")]
            if not gone:
                after = 3 if q == 2 else 2
                options.append((after, c + 1 + 5 * unfinished, a + "R"))
                keeps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                if keeps is not None:
                    options.append((keeps, c + 5 * unfinished, a + "K"))
            for s, cost, audit in options:
                new[s] = min(new.get(s, (10**9, "")), (cost, audit))
        best = new
    best = _inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def _inserted(best):
    for _ in range(2):
        for q, (c, a) in list(best.items()):
            s = 3 if q == 2 else 2
            best[s] = min(best.get(s, (10**9, "")), (c + 5, a + "I"))
    return best


def plain_repair(rows):
    """What ``repaired`` says of one conversation's rows ``(turn, role, text, copies)``."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x, k in rows for _ in range(k)], key=key)
    seen, marks = set(), []
    count = Counter()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        marks.append((role[:1] if role[:1] in "sua" else "o", fault in ("blank", "duplicate"), fault == "truncated"))
    count["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest(marks)
    lines, state, left = [], 0, iter(rows)
    for e in audit:
        _, role, text = (0, "", "") if e == "I" else next(left)
        if e == "D":
            continue
        if e in "RI":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        lines.append((role, text))
    said = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, hashlib.sha256(said.encode()).hexdigest()), lines


@pytest.mark.parametrize("pieces", [None, 7])
def test_repair_equals_a_plain_search(spark, pieces):
    rng = random.Random(11)
    rows, by = [], {}
    for conv in [None, *range(60), BIG + 1, BIG + 3]:
        size = 900 if conv == 5 else rng.choice([1, 2, 5, 9])
        for t in range(size):
            turn = rng.choice([t, t, t, None, 3])
            role = "user" if conv == 5 and t % 300 > 40 else rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "", " \n", None, f"text {t}!  ", f"cut {t}", f"it is {t}.", f"so {t}?"])
            rows.append((conv, turn, role, text, rng.choice([1, 1, 1, 1, 2, 0 if conv else 1])))
            by.setdefault(conv, []).append(rows[-1][1:])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").selectExpr("*", "'x' as piece", "1 as at", "2 as _tie", "3 as symbol")
    got = {r.conv_id: tuple(r)[1:] for r in conversation.repaired(frame, "copies", pieces).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == plain_repair(own)[0], conv
    lines = {}
    for r in sorted(conversation.repaired_turns(frame, "copies", pieces).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert lines == {conv: said for conv, own in by.items() if (said := plain_repair(own)[1])}
    assert conversation.repaired(frame.limit(0), "copies").count() == 0


def test_runs_advance_by_powers():
    for symbol in conversation.SYMBOLS:
        step, end = conversation.power(symbol, 0), [3, 1, 4, 1]
        for n in range(1, 40):
            end = conversation.applied(step, end)
            assert conversation.behind_run(symbol, n, [3, 1, 4, 1]) == end
        one_by_one = list(conversation._costs_behind(symbol, 39, [3, 1, 4, 1]))
        assert len(one_by_one) == 39 and conversation.applied(step, one_by_one[0]) == end and one_by_one[-1] == [3, 1, 4, 1]


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in [None, 1, BIG + 1] for t in [None, *range(30)]]
    got = conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        fate = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        want = {0: ("assistant", rows[0][3], 0), 1: ("assistant", "", 1), 2: ("assistant", "One Two Three", 1), 3: ("assistant", rows[0][3], 2), 4: ("user", rows[0][3], 1)}
        assert (r.role, r.text, r.copies) == want.get(fate, ("assistant", rows[0][3], 1))


# decontamination


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def plain_judgement(docs, items, window):
    windows, suffixes = [], []
    for item, text in items:
        w = bench_words(text)
        size = min(window, len(w))
        windows += [(w[k : k + size], item) for k in range(len(w) - size + 1 if size else 0)]
        suffixes += [w[k:] for k in range(len(w) - size + 1)]
    for doc_id, text in docs:
        w, hit, found, longest = bench_words(text), set(), set(), 0
        for x, item in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= {*range(p, p + len(x))}
                    found |= {str(item)} if item is not None else set()
                    longest = max(longest, *(common(w[p:], v) for v in suffixes))
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest


@pytest.mark.parametrize(("window", "letters"), [(3, ["a", "b"]), (4, ["a", "B", "É", "é", "q1"]), (10, ["a", "b"])])
def test_decontamination_equals_plain_search(spark, window, letters):
    rng = random.Random(window)
    text = lambda sizes, more: rng.choice([None, "", " ; "]) if rng.random() < 0.1 else ", ".join(rng.choice(letters + more) for _ in range(rng.choice(sizes)))
    least = [2, 5, 9, 14] if window == 4 else [14, 15, 20]
    items = [(rng.choice([1, 2, 3, 10, 20, None, BIG + 1]), text(least, [])) for _ in range(12)]
    docs = [(rng.choice([None, BIG + 1, BIG + 3, 5]), text([1, 2, 5, 20, 60], ["zz"])) for _ in range(50)]
    docs += [(6, "zz " * 5000 + ("a " * 14)), *docs[:3]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _n_words", "2 as _text", "'x' as item_id").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = sorted(plain_judgement(docs, items, window), key=str)
    for s in (decontaminate.Settings(window), decontaminate.Settings(window, shard_words=30, spellings=2)):
        assert sorted((tuple(r) for r in decontaminate.judged(frame, tests, s).collect()), key=str) == want
    # in several blocks of items the hits are the same; only a match over items of one block is as long as its block has it
    blocks = decontaminate.judged(frame, tests, decontaminate.Settings(window, block_words=8)).collect()
    assert sorted((tuple(r)[:-1] for r in blocks), key=str) == sorted((r[:-1] for r in want), key=str)
    clean = decontaminate.decontaminated(frame, tests, decontaminate.Settings(window))
    assert clean.columns == frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)
    assert decontaminate.judged(frame, tests.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judged(frame.limit(0), tests).count() == 0
    for r in decontaminate.matches(spark.createDataFrame([(1, " zz ".join(t for _, t in items if t))], "doc_id long, text string"), tests, decontaminate.Settings(window)).collect():
        own = [bench_words(t) for i, t in items if t and (None if i is None else str(i)) == r.item_id]
        words = bench_words(" zz ".join(t for _, t in items if t))[r.first_word : r.first_word + r.words]
        assert any(v[r.item_word : r.item_word + r.words] == words for v in own)
