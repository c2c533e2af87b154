"""Queries of the data problems that SQL can't express, against plain Python over the smallest tables."""

import os
from collections import Counter, defaultdict

import pandas as pd
import pytest

from quern.functions.scores import parse_score, stated_scale
from quern.queries.problems import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def scored():
    """(review row, thousandths or None) of every review."""
    reviews = pd.read_parquet(f"{DATA}/reviews.parquet").to_dict("records")
    worth = dict(pd.read_parquet(f"{DATA}/grade_scale.parquet")[["grade", "pct"]].values.tolist())
    told = defaultdict(Counter)
    parsed = [parse_score(r["originalScore"] or "") for r in reviews]
    for r, s in zip(reviews, parsed):
        if r["publicationName"] and s.kind in ("scaled", "grade"):
            told[r["publicationName"]][s.scale if s.kind == "scaled" else -1] += 1
    habit = {p: c.most_common(1)[0][0] for p, c in told.items() if c.most_common(1)[0][1] * 5 >= sum(c.values()) * 3}
    out = []
    for r, s in zip(reviews, parsed):
        milli = s.milli
        if s.kind == "grade":
            milli = 10 * worth[s.grade] if s.grade in worth else None
        elif s.kind == "bare":
            scale = stated_scale(r["reviewText"] or "") or habit.get(r["publicationName"])
            milli = int(1000 * s.value / scale + 1 / 2) if scale and scale > 0 and s.value <= scale else None
        out.append((r, milli))
    return out


def test_scores(spark, scored):
    want = {(r["reviewId"], m) for r, m in scored if m is not None}
    rows = [tuple(r) for r in QUERIES["p2_found"](spark, DATA).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_mean_scores(spark, scored):
    groups = defaultdict(list)
    for r, m in scored:
        if r["id"] is not None:
            groups[r["id"]].append(m)
    for r in QUERIES["p3_mean_scores"](spark, DATA).collect():
        known = [m for m in groups[r["id"]] if m is not None]
        assert (r["n_rows"], r["n_scored"]) == (len(groups[r["id"]]), len(known))
        assert r["heavy"] == (len(groups[r["id"]]) * 50 >= len(scored))
        assert r["mean_milli"] == (pytest.approx(sum(known) / len(known), abs=1e-3) if known else None)


def test_packed_fields_without_quotes(spark):
    """Fields of plain damages between delimiters of one kind need no model to be split."""
    images = pd.read_parquet(f"{DATA}/car_images.parquet").dropna(subset=["damage_status"])
    got = defaultdict(dict)
    for r in QUERIES["p4_found"](spark, DATA).collect():
        got[r["image_id"]][r["pos"]] = r["damage"]
    plain = images[images.damage_status.str.fullmatch(r"[A-Za-z_]+( ?[;,|/] ?[A-Za-z_]+)+")]
    assert len(plain)
    for r in plain.itertuples():
        want = [x.strip() for x in pd.Series([r.damage_status]).str.split(r"[;,|/]", regex=True)[0]]
        assert [got[r.image_id][k] for k in sorted(got[r.image_id])] == want
