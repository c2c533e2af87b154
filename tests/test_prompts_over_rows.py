"""Reduction, comparison, generation and SQL calls with models that read their prompts."""

import json

import pytest
from pyspark.sql import functions as F

from quern.evaluation import metrics as ev
from quern.functions.sql import expand, register
from quern.models.base import ExpressionModel
from quern.models.remote import RemoteModel
from quern.operators import semantic as sem
from quern.streaming.ingest import ingest_embeddings


@pytest.fixture
def total():
    """A client that adds up the numbers of the rows it is told."""
    return lambda prompt: (str(sum(int(w.split(": ")[-1]) for w in prompt.split("\n")[1:])), 1, 1)


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(k, k % 3 if k % 7 else None, "x" if k else None) for k in range(60)] + [(None, 1, "x")]
    return spark.createDataFrame(rows, "n int, g int, _said string").repartition(3)


@pytest.mark.parametrize("fan_in", [2, 7, 64])
def test_reduction_in_several_levels(numbers, total, fan_in):
    model = RemoteModel(total)
    want = {}
    for k in range(60):
        g = k % 3 if k % 7 else None
        want[g] = want.get(g, 0) + k
    got = sem.sem_reduce(numbers, "Add up {n}", model, "sum", ["g"], fan_in)
    assert {r["g"]: int(r["sum"]) for r in got.collect()} == want
    assert [int(r["sum"]) for r in sem.sem_reduce(numbers, "Add up {n}", model, "sum", fan_in=fan_in).collect()] == [sum(range(60))]
    assert sem.sem_reduce(numbers.limit(0), "Add up {n}", model, "sum").count() == 0


def test_topk_by_comparison(spark, monkeypatch):
    monkeypatch.setattr(sem, "PIVOTS", 4)
    df = spark.createDataFrame([(k, (k * 7) % 31 if k % 5 else None) for k in range(200)], "id int, v int")
    model = ExpressionModel({"{v:left} before {v:right}": lambda a, b: a > b})
    for k in (0, 1, 6, 25, 150, 300):
        got = sem.sem_topk_by(df, "{v:left} before {v:right}", model, k, "id").collect()
        values = sorted((r["v"] for r in df.collect() if r["v"] is not None), reverse=True)
        top = sorted((r["v"] for r in got if r["v"] is not None), reverse=True)
        assert len(got) == min(k, 200) and (k > 100 or top == values[:k])
        assert all(r["rank"] == 1 + sum(x > r["v"] for x in top) for r in got if r["v"] is not None)


def test_topk_of_equal_rows_goes_by_key(spark):
    df = spark.createDataFrame([(k, 1) for k in range(50)], "id int, v int")
    model = ExpressionModel({"{v:left} before {v:right}": lambda a, b: a > b})
    assert sorted(r["id"] for r in sem.sem_topk_by(df, "{v:left} before {v:right}", model, 5, "id").collect()) == [0, 1, 2, 3, 4]


def test_labels_are_told_with_their_descriptions(spark):
    asked = []

    def client(prompt):
        asked.append(prompt)
        return "dress" if "one piece" in prompt and "long" in prompt else "shoe", 1, 1

    df = spark.createDataFrame([("long",), ("short",), (None,)], "t string")
    got = sem.sem_classify(df, "What is {t}?", {"dress": "one piece", "sock": "for feet"}, RemoteModel(client), "c").collect()
    assert {r["t"]: r["c"] for r in got} == {"long": "dress", "short": None, None: None}


def test_typed_generation(spark):
    model = ExpressionModel({"Describe {t}": lambda t: t})
    df = spark.createDataFrame([('{"a": 1, "b": ["x"]}',), ("nonsense",), (None,), ('{"a": "?"}',)], "t string")
    got = sem.sem_generate(df, "Describe {t}", model, "a int, b array<string>").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, ["x"]), (None, None), (None, None), (None, None)]


def test_calls_in_sql_text():
    answers = {"which?": "lower($1)", "same?": "$1 = $2"}
    assert expand("SELECT AI_CLASSIFY('Which?', a.x, ARRAY('p', 'q (r)'))", answers) == "SELECT (CASE WHEN (lower(a.x)) IN ('p', 'q (r)') THEN (lower(a.x)) END)"
    assert expand("a JOIN b ON AI_JOIN('Same?', a.x, b.y)", answers) == "a JOIN b ON (a.x = b.y)"


def test_registered_functions(spark):
    register(spark, lambda p: ("b" if "\n- " not in p and "Answer with" in p else str(p.count("\n")), 1, 1))
    got = spark.sql("SELECT ai_classify('x', array('a', 'b')) AS c, ai_classify('x', array('q')) AS n, ai_reduce('sum', array('u', 'v', NULL)) AS r, ai_reduce(NULL, array('u')) AS z").first()
    assert tuple(got) == ("b", None, "2", None)


def test_signature_and_modalities(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, 2.0), ("b", 3, 4.0)], "k string, x int, y double")
    got = sem.group_by_signature(df, ["k"], ["count", "average"], ["x", "y"])
    assert got.columns == ["k", "count(x)", "average(y)"] and sorted(tuple(r) for r in got.collect()) == [("a", 1, 2.0), ("b", 1, 4.0)]
    with pytest.raises(ValueError):
        sem.group_by_signature(df, ["k"], ["median"], ["x"])
    assert df.filter(sem.several_of([F.col("x") > 0, F.col("y") > 0], 2)).count() == 1


def test_padded_gold(spark):
    gold = spark.createDataFrame([(k,) for k in range(30)], "id int")
    score = lambda ids, n: tuple(ev.padded(spark.createDataFrame([(k,) for k in ids], "id int"), gold, "id", n).first())
    assert score([0, 1, 99], 10)[:2] == (pytest.approx(2 / 3), 0.2) and score([], 10)[2] == 0.0
    with pytest.raises(Exception, match="more than 10 hits"):
        score(range(12), 10)


def test_embeddings_are_kept_once_at_length_one(spark, tmp_path):
    rows = [{"id": 1, "v": [3.0, 4.0]}, {"id": 2, "v": [0.0, 0.0]}, {"id": 1, "v": [1.0, 0.0]}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:2]))
    for k in range(2):
        stream = spark.readStream.schema("id int, v array<double>").json(str(tmp_path / "in"))
        ingest_embeddings(stream, "id", "v", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        (tmp_path / "in" / f"b{k}.json").write_text(json.dumps(rows[2]))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, [0.6, 0.8])]
