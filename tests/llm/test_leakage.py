import random

import numpy as np
import pyarrow as pa
import pytest

from quern.functions.bytewords import words_of
from quern.llm import leakage as lk

rng = random.Random(4)
WORDS = [f"{a}{b}" for a in ("bel", "cor", "dan", "fur", "gim", "hal") for b in ("ta", "no", "ri", "su", "ke", "lo", "mi")]


def text(n):
    return [rng.choice(WORDS) for _ in range(n)]


def hashes(words):
    (w,) = words_of(pa.array([" ".join(words)]))
    return w.hashes


def noisy(words, every):
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            out += rng.choice([[], ["zzz"], [w, "zzz"]])
        else:
            out.append(w)
    return out


def brute(passage, doc):
    """Longest stretch by a full alignment table over all starting places, one edit in eight at most."""
    best = 0
    for i0 in range(len(passage)):
        for j0 in range(len(doc)):
            if passage[i0] != doc[j0]:
                continue
            n, m = min(len(passage) - i0, 40), min(len(doc) - j0, 48)
            cost = np.full((n + 1, m + 1), 99)
            cost[0, 0] = 0
            for i in range(n + 1):
                for j in range(m + 1):
                    if i and j:
                        cost[i, j] = min(cost[i, j], cost[i - 1, j - 1] + (passage[i0 + i - 1] != doc[j0 + j - 1]))
                    if i:
                        cost[i, j] = min(cost[i, j], cost[i - 1, j] + 1)
                    if j:
                        cost[i, j] = min(cost[i, j], cost[i, j - 1] + 1)
            for i in range(1, n + 1):
                if any(cost[i, j] * 8 <= i and passage[i0 + i - 1] == doc[j0 + j - 1] for j in range(1, m + 1)):
                    best = max(best, i)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_stretches_against_brute_force(seed):
    rng.seed(seed)
    passage = text(30)
    part = passage[rng.randrange(8) :][: rng.randrange(10, 22)]
    doc = text(8) + noisy(part, rng.choice([8, 9, 12, 99])) + text(8)
    assert lk.holds(lk.Grams(hashes(passage)), lk.Grams(hashes(doc))) == (brute(passage, doc) >= lk.LEAST_WORDS)


def test_every_shared_run_of_five_words_keeps_a_print():
    for seed in range(60):
        rng.seed(seed)
        run = text(5)
        sides = [text(rng.randrange(6)) + run + text(rng.randrange(6)) for _ in range(2)]
        prints = []
        for s in sides:
            (w,) = words_of(pa.array([" ".join(s)]))
            from quern.functions.bytewords import gram_rows

            h, counts = gram_rows(w, lk.GRAM)
            prints.append(set(h[lk._winnow(h, np.repeat([0], counts))].tolist()))
        assert prints[0] & prints[1]


@pytest.fixture(scope="module")
def tables(spark):
    rng.seed(1)
    items = {k: text(40) for k in range(1, 7)}
    docs = {
        10: " ".join(text(50) + items[1] + text(20)),
        11: "<p>" + "\n".join(w.upper() for w in items[2][5:25]) + ",</p> " + " ".join(text(9)),
        12: " ".join(text(9) + items[3][:12] + text(30)),
        13: " ".join(noisy(items[4], 8)),
        14: " ".join(noisy(items[5], 3)),
        15: "", 16: None, 17: " ".join(text(5)), 18: "x " * 100_000 + " ".join(items[6]),
    }
    d = spark.createDataFrame([(k, v, "q", 1) for k, v in docs.items()] + [(10, docs[10], "q", 1), (None, docs[10], "q", 1)], "doc_id long, text string, words string, id int")
    i = spark.createDataFrame([(k, " ".join(v), None) for k, v in items.items()] + [(7, None, "?"), (8, "short one", "?"), (None, "x", None)], "item_id long, passage string, question string")
    return d.repartition(3), i


WANT = {(10, 1), (11, 2), (13, 4), (18, 6)}


def test_leaked_items(tables):
    d, i = tables
    assert {tuple(r) for r in lk.leaked(d, "doc_id", "text", i, "item_id", "passage").collect()} == WANT


@pytest.mark.parametrize("words", [1, 100])
def test_slabs_of_any_size_give_the_same(tables, monkeypatch, words):
    d, i = tables
    monkeypatch.setattr(lk, "SLAB_WORDS", words)
    assert {tuple(r) for r in lk.leaked(d, "doc_id", "text", i, "item_id", "passage").collect()} == WANT


@pytest.mark.parametrize("words", [60, 1 << 20])
def test_every_passage_of_an_item_is_looked_for(spark, monkeypatch, words):
    monkeypatch.setattr(lk, "SLAB_WORDS", words)
    rng.seed(8)
    one, two = text(30), text(30)
    i = spark.createDataFrame([(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(two))], "item_id long, passage string")
    d = spark.createDataFrame([(10, " ".join(text(9) + one + text(9))), (11, " ".join(text(9) + two)), (12, " ".join(text(40)))], "doc_id long, text string")
    assert sorted(tuple(r) for r in lk.leaked(d, "doc_id", "text", i, "item_id", "passage").collect()) == [(10, 1), (11, 1)]


@pytest.mark.parametrize("words", [200, 1 << 20])
def test_a_phrase_in_every_item_and_text_is_no_leak(spark, monkeypatch, words):
    monkeypatch.setattr(lk, "SLAB_WORDS", words)
    rng.seed(9)
    phrase = "choose the right answer from the list that follows here now".split()
    passages = {k: text(12) + phrase + text(14) for k in range(8)}
    docs = {k: text(10) + phrase + text(10) for k in range(8)} | {99: text(5) + passages[7][6:26] + text(5)}
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in passages.items()], "item_id long, passage string")
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    want = {(k, m) for k, v in docs.items() for m, p in passages.items() if brute(p, v) >= lk.LEAST_WORDS}
    assert {tuple(r) for r in lk.leaked(d, "doc_id", "text", i, "item_id", "passage").collect()} == want
    assert (99, 7) in want and len(want) < 20


def test_several_edits_side_by_side(spark):
    rng.seed(10)
    passage = text(27)
    kept = passage[:12] + ["x1", "x2", "x3"] + passage[15:]
    worse = passage[:11] + ["x1", "x2", "x3", "x4"] + passage[15:]
    i = spark.createDataFrame([(1, " ".join(passage))], "item_id long, passage string")
    d = spark.createDataFrame([(1, " ".join(text(9) + kept + text(9))), (2, " ".join(text(9) + worse + text(9)))], "doc_id long, text string")
    assert [tuple(r) for r in lk.leaked(d, "doc_id", "text", i, "item_id", "passage").collect()] == [(1, 1)]


@pytest.mark.parametrize("seed", range(30))
def test_the_alignment_against_brute_force(seed):
    rng.seed(100 + seed)
    passage = text(44)
    part = passage[rng.randrange(6) :][: rng.randrange(15, 40)]
    for _ in range(rng.randrange(1, 5)):
        k = rng.randrange(len(part) - 4)
        part[k : k + rng.randrange(0, 4)] = ["zz"] * rng.randrange(0, 3)
    doc = text(8) + part + text(8)
    want = brute(passage, doc) >= lk.LEAST_WORDS
    assert lk.holds(lk.Grams(hashes(passage)), lk.Grams(hashes(doc))) == want


def test_empty_tables(tables):
    d, i = tables
    assert lk.leaked(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert lk.leaked(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0


def test_accents_do_not_count(spark):
    rng.seed(3)
    words = ["élan", "über", "straße", "coração", "niño"] * 4
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    i = spark.createDataFrame([(1, "elan uber strasse coracao nino " * 4)], "item_id long, passage string")
    assert lk.leaked(d, "doc_id", "text", i, "item_id", "passage").count() == 1
