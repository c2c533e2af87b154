"""Searches of many queries, against plain Python."""

import numpy as np
import pytest

from quern.operators import semantic as sem


@pytest.mark.parametrize(("slab", "scores"), [(sem.SLAB_QUERIES, sem.SLAB_SCORES), (3, 40)])
def test_every_query_is_searched_against_all_rows(spark, monkeypatch, slab, scores):
    monkeypatch.setattr(sem, "SLAB_QUERIES", slab)
    monkeypatch.setattr(sem, "SLAB_SCORES", scores)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 5)).astype(np.float32)
    v[150:] = v[100:150]  # ties
    data = [(k, [float(x) for x in v[k]]) for k in range(200)] + [(1000, [0.0] * 5), (1001, None), (None, [1.0] * 5), (1002, [1.0])]
    df = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    got = {}
    for r in sem.retrieve_many(df, "id", "v", df.filter("id % 20 = 0"), 7).collect():
        got.setdefault(r["query_id"], []).append((-r["similarity"], r["id"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    assert set(got) == set(range(0, 200, 20))
    for q, found in got.items():
        want = sorted((-round(float(u[k] @ u[q]), 9), k) for k in range(200))[:7]
        assert [k for _, k in sorted(found)] == [k for _, k in want]
        assert [s for s, _ in sorted(found)] == pytest.approx([s for s, _ in want], abs=2e-9)
    assert sem.retrieve_many(df, "id", "v", df.filter("false"), 7).count() == 0
