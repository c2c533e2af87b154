"""Rewrites of plans whose nodes are shared give the rows of the plan as written."""

import random

import pytest
from pyspark.sql import functions as F

from quern.models.base import ExpressionModel
from quern.plans import plan as pl

MODEL = ExpressionModel({"{id} is even": lambda c: c % 2 == 0, "{id} is a third": lambda c: c % 3 == 0, "{id} is small": lambda c: c < 7})


@pytest.fixture(scope="module")
def ten(spark):
    return spark.range(10)


def union(*dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.union(d)
    return out


def same(node, rows):
    before = rows(pl.run(node))
    assert rows(pl.run(pl.optimise(node))) == before == rows(pl.run(node))
    return before


def test_a_shared_filter_keeps_its_rows(ten, rows):
    s = pl.SemFilter([pl.Scan(df=ten)], prompt="{id} is even", model=MODEL)
    both = pl.Rel([pl.Filter([s], condition=F.col("id") > 5), s], union)
    assert [r[0] for r in same(both, rows)] == [0, 2, 4, 6, 6, 8, 8]


def test_a_shared_filter_under_a_join_stays(ten, rows):
    s = pl.SemFilter([pl.Scan(df=ten)], prompt="{id} is even", model=MODEL)
    j = pl.Join([s, pl.Scan(df=ten.filter("id > 3"))], on=[("id", "id")], selective=True)
    same(pl.Rel([j, s, j], union), rows)
    alone = pl.optimise(pl.Join([pl.SemFilter([pl.Scan(df=ten)], prompt="{id} is even", model=MODEL), pl.Scan(df=ten)], on=[("id", "id")], selective=True))
    assert isinstance(alone, pl.SemFilter) and isinstance(alone.inputs[0], pl.Join)


@pytest.mark.parametrize("seed", range(12))
def test_random_plans_with_sharing(ten, rows, seed):
    r = random.Random(seed)
    nodes = [pl.Scan(df=ten), pl.Scan(df=ten.filter("id % 4 < 3"))]
    for _ in range(9):
        kind, x = r.randrange(4), r.choice(nodes[-4:])
        if kind == 0:
            nodes.append(pl.Filter([x], condition=F.col("id") > r.randrange(4)))
        elif kind == 1:
            nodes.append(pl.SemFilter([x], prompt=r.choice(list(MODEL.answers)), model=MODEL, price=r.random(), selectivity=r.random()))
        elif kind == 2:
            nodes.append(pl.Join([x, pl.Rel([r.choice(nodes)], lambda d: d.distinct())], on=[("id", "id")], selective=r.random() < 0.7))
        else:
            nodes.append(pl.Rel([x, r.choice(nodes)], lambda a, b: a.union(b)))
    same(pl.Rel(nodes[-3:], union), rows)
