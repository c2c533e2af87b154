import itertools
import os
import random

import numpy as np
import pytest

from quern.llm import packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files here")


def test_completion_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        sizes = np.array([rng.randrange(1, 30) for _ in range(rng.randrange(1, 10))])
        room = rng.randrange(1, 60)
        best = max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes.tolist(), n) if sum(c) <= room)
        got, certain = packing.complete(packing.Sizes(sizes), room, steps=None)
        assert sum(got) == best and certain
        assert all(got.count(s) <= sizes.tolist().count(s) for s in got)


def test_fill_uses_every_item_once_and_no_container_overflows():
    rng = random.Random(9)
    sizes = np.array([rng.randrange(1, 2048) for _ in range(3000)])
    filled, _ = packing.fill(sizes, 2048)
    assert sorted(itertools.chain.from_iterable(filled)) == list(range(3000))
    assert max(sizes[c].sum() for c in filled) <= 2048
    assert len(filled) <= 1.02 * -(-sizes.sum() // 2048) + 1


def test_many_tiny_and_many_large_items():
    assert len(packing.fill(np.ones(5000, np.int64), 2048)[0]) == 3
    assert len(packing.fill(np.full(300, 1500), 2048)[0]) == 300
    assert packing.fill(np.zeros(0, np.int64), 2048) == ([], [])


def test_a_search_out_of_steps_is_told():
    sizes = np.array([2 * k for k in range(20, 60)])  # an odd room can't be filled, and many ways nearly fill it
    full, certain = packing.complete(packing.Sizes(sizes), 501, steps=None)
    some, told = packing.complete(packing.Sizes(sizes), 501, steps=3)
    assert certain and not told and sum(full) == 500 and sum(some) <= 500


def test_branches_that_cannot_win_are_cut_off():
    sizes = np.array([1000, 3, 2, 1])
    assert packing.complete(packing.Sizes(sizes), 1500, steps=1) == ([1000, 3, 2, 1], True)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, "word and " * rng.randrange(1, 700), "x") for i in range(900)]
    rows += [(5000, "long text " * 9000, "x"), (5001, None, "x"), (5002, "", "x"), (None, "y", "x"), (1, rows[1][1], "x"), (5003, " ", "x")]
    return spark.createDataFrame(rows, "id long, body string, container string").repartition(3)


def test_packing_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    monkeypatch.setattr(packing, "KEEP", 5)
    rows = packing.pack(docs, "id", "body").collect()
    fills = {}
    for r in rows:
        fills[r["container"]] = fills.get(r["container"], 0) + r["n_tokens"]
    assert max(fills.values()) <= packing.CAPACITY and all(fills[r["container"]] == r["fill"] for r in rows)
    whole = [r for r in docs.collect() if r["id"] is not None and r["body"]]
    want = sorted((r["id"], n) for r, n in zip(whole, packing.token_counts([r["body"] for r in whole], packing.TOKENIZER)))
    got = {}
    for r in rows:
        got.setdefault((r["id"]), []).append((r["piece_no"], r["n_tokens"]))
        assert r["first_token"] == (r["piece_no"] - 1) * packing.CAPACITY
    assert sum(n for _, n in want) == sum(r["n_tokens"] for r in rows)
    for i, n in want:
        if i != 1:
            assert sum(s for _, s in got[i]) == n
            assert len(got[i]) == max(1, -(-n // packing.CAPACITY)) and [p for p, _ in sorted(got[i])] == list(range(1, len(got[i]) + 1))
    least = -(-sum(n for _, n in want) // packing.CAPACITY)
    assert least <= len(fills) <= 1.03 * least + 1


def test_summary_and_empty_table(docs):
    assert packing.pack(docs.limit(0), "id", "body").count() == 0
    s = packing.summary(packing.pack(docs.limit(20), "id", "body")).first()
    assert s["least_containers"] <= s["n_containers"] and 0 <= s["unused"] < 1
