import pytest
from pyspark.sql import functions as F

from quern.functions.prompts import Prompt, parse_between_tags, parse_boolean, parse_json, to_boolean, to_number
from quern.functions.sql import expand, register, sem_sql
from quern.models.base import EmbeddingModel, ExpressionModel, ModelRegistry, ModelSpec
from quern.models.remote import RemoteModel
from quern.operators import semantic as sem


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "ann", 3), (2, "bob", None), (3, None, 5), (3, None, 5)], "id int, name string, score int")


LONG = "{name} has a long name"
MODEL = ExpressionModel({LONG: lambda c: F.length(c) > 2, "the score of {name}": "score", "{name:left} is {name:right}": lambda a, b: a == b})


def test_prompts_know_their_columns(people):
    p = Prompt("Is {a} like  {b:right}?")
    assert p.slots == [("a", None), ("b", "right")] and p.key == "is {a} like {b:right}?"
    with pytest.raises(ValueError, match="nothere"):
        sem.sem_filter(people, "{nothere} is good", MODEL)
    assert [r[0] for r in people.select(Prompt("<{name}> {id}").render()).collect()][:3] == ["<ann> 1", "<bob> 2", None]


def test_filter_and_its_default(people):
    assert sem.sem_filter(people, LONG, MODEL).count() == 2
    assert sem.sem_filter(people, LONG, MODEL, default=True).count() == 4
    assert sem.sem_filter(people.limit(0), LONG, MODEL).count() == 0


def test_plain_filters_go_below_python_ones_and_native_models_need_none(spark, people):
    plan = sem.sem_filter(people, LONG, MODEL)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_score_rubric(spark):
    answers = spark.createDataFrame([("4",), ("7",), ("n/a",), (None,)], "answer string")
    out = sem.sem_score(answers, "{answer}", ExpressionModel({"{answer}": lambda c: c.try_cast("double")}), "s")
    assert [r["s"] for r in out.collect()] == [4.0, 3.0, 3.0, 3.0]


def test_rank_spread(spark):
    five = spark.createDataFrame([(i, float(i)) for i in range(5)], "id int, s double").repartition(3)
    assert [r["spread"] for r in sem.rank_spread(five, "s", "id", "spread").orderBy("id").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert [r["spread"] for r in sem.rank_spread(five.limit(1), "s", "id", "spread").collect()] == [3.0]
    grouped = sem.rank_spread(five.withColumn("g", F.col("id") % 2), "s", "id", "spread", ["g"]).orderBy("id")
    assert [r["spread"] for r in grouped.collect()] == [1.0, 1.0, 3.0, 5.0, 5.0]


def test_topk_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, 1.0, "a"), (1, 1.0, "a"), (2, 2.0, "b"), (4, None, "b")], "id int, s double, g string")
    assert [r["id"] for r in sem.sem_topk(df, "s", 2, "id").collect()] == [2, 1]
    assert sorted(r["id"] for r in sem.sem_topk(df, "s", 1, "id", ["g"]).collect()) == [1, 2]


def test_joins(spark, people):
    other = spark.createDataFrame([(1, "ann"), (1, "bob"), (2, None)], "id int, name string")
    prompt = "{name:left} is {name:right}"
    inner = sem.sem_join(people, other, prompt, MODEL, on=[("id", "id")])
    assert [(r["id_left"], r["name_right"]) for r in inner.collect()] == [(1, "ann")]
    keyed = people.withColumn("row", F.monotonically_increasing_id())
    left = sem.sem_join(keyed, other, prompt, MODEL, on=[("id", "id")], how="left", row_id="row")
    assert left.count() == 4 and left.filter("name_right IS NOT NULL").count() == 1
    assert sem.sem_join(people, other, prompt, MODEL).count() == 2
    alone = sem.sem_join(people, people, prompt, MODEL, on=[("id", "id")], unlike=("id", "id"))
    assert alone.count() == 0


@pytest.mark.parametrize("rows, chars", [(2, 1 << 26), (100, 40)])
def test_join_without_keys_takes_a_large_right_side_in_blocks(spark, people, monkeypatch, rows, chars):
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["Ann", "Bob", None, "Cid", "Ann", "Dee"])], "key int, name string")
    model = ExpressionModel({"{name:left} is {name:right}": lambda a, b: a == b})
    join = lambda: sorted((r["name_left"], r["key"]) for r in sem.sem_join(people, names, "{name:left} is {name:right}", model).collect())
    want = join()
    monkeypatch.setattr(sem, "UNKEYED_ROWS", rows)
    monkeypatch.setattr(sem, "UNKEYED_CHARS", chars)
    assert len(sem._blocks(names)) > 1 and join() == want


def test_nearest_class_by_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.2, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0])], "id int, v array<double>")
    classes = spark.createDataFrame([(k, [float(x), float(y)]) for k, (x, y) in enumerate([(1, 0), (0, 1), (1, 0), (-1, -1), (1, 1)])], "label int, p array<double>")
    near = lambda: sorted((str(r["id"]), r["c"]) for r in sem.classify_nearest(df, "id", "v", classes, "label", "p", "c").collect())
    want = near()
    assert want == [("1", 0), ("2", 1), ("3", 3), ("4", 0), ("None", 4)]
    monkeypatch.setattr(sem, "UNKEYED_ROWS", 2)
    assert near() == want


def test_common_answers(spark):
    df = spark.createDataFrame([("m1", "ann"), ("m1", "bob"), ("m2", "ann"), ("m2", None), (None, "bob")], "movie string, actor string")
    assert [r[0] for r in sem.sem_agg(df, "actor", "movie", "common").collect()] == ["ann"]


def test_cascade(spark):
    pairs = spark.createDataFrame([(1, 0.9, False), (2, 0.5, True), (3, 0.5, False), (4, 0.1, True), (5, None, True)], "id int, s double, truth boolean")
    out = sem.join_cascade(pairs, F.col("s"), 0.8, 0.3, F.col("truth"))
    assert sorted((r["id"], r["decided_by"]) for r in out.collect()) == [(1, "proxy"), (2, "oracle")]
    sample = spark.createDataFrame([(i / 100, i >= 50) for i in range(100)], "s double, truth boolean")
    accept, reject = sem.cascade_thresholds(sample, "s", "truth")
    assert 0.3 <= accept <= 0.5 or accept >= reject
    assert sample.filter(f"s >= {reject} AND truth").count() >= 0.8 * 50


def test_nearest_class_and_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    protos = spark.createDataFrame([("x", [1.0, 0.1]), ("y", [0.1, 1.0])], "label string, p array<float>")
    got = {r["id"]: r["c"] for r in sem.classify_nearest(v, "id", "v", protos, "label", "p", "c").collect()}
    assert got[1] == "x" and got[2] == "y"
    assert [r["id"] for r in sem.retrieve(v, "id", "v", [1.0, 0.0], 1).collect()] == [1]
    near = EmbeddingModel(0.9).answer(v.withColumn("w", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))), Prompt("{v} is like {w}"), "near")
    assert [r["near"] for r in near.orderBy("id").collect()] == [True, False, None]


def test_remote_model_asks_once_keeps_answers_and_tells_usage(spark, people, tmp_path):
    def client(prompt):
        if "fail" in prompt:
            raise TimeoutError("slow")
        return ("true" if "ann" in prompt else "maybe", len(prompt), 1)

    model = RemoteModel(client, ModelSpec("fake"), attempts=2, pause=0.0, cache=str(tmp_path / "cache"))
    out = model.answer(people, Prompt("it is {name}."), "yes", "boolean")
    assert [(r["yes"], r["yes_usage"]["in_tokens"] if r["yes_usage"]["in_tokens"] else None) for r in out.orderBy("id").collect()][:2] == [(True, 10), (None, 10)]
    again = model.answer(people, Prompt("it is {name}."), "yes", "boolean")
    assert again.agg(F.sum("yes_usage.in_tokens")).first()[0] == 0
    failed = model.complete(spark.createDataFrame([("fail",)], "prompt string")).first()
    assert failed["answer"] is None and "TimeoutError" in failed["error"]


def test_answer_parsers(spark):
    df = spark.createDataFrame([("It is TRUE.",), ("false",), ("true or false",), ("<a>\nx </a>",), ('so: {"n": 3} ok',), ("seven",), ("2.5",)], "a string")
    got = df.select(parse_boolean(F.col("a")), parse_between_tags(F.col("a"), "a"), parse_json(F.col("a"), "n int")["n"], to_number(F.col("a")), to_boolean(F.col("a"))).collect()
    assert [r[0] for r in got[:3]] == [True, False, None] and got[3][1] == "x" and got[4][2] == 3
    assert [r[3] for r in got[5:]] == [7.0, 2.5] and got[1][4] is False


def test_sql_functions(spark, people):
    people.createOrReplaceTempView("people")
    text = "SELECT id FROM people WHERE AI_IF('it''s long', name) AND AI_SCORE('rate', score) >= :least"
    assert expand(text, {"it's long": "length($1) > 2", "rate": "$1"}).count("AI_") == 0
    assert [r[0] for r in sem_sql(spark, text, {"it's long": "length($1) > 2", "rate": "$1"}, least=3).collect()] == [1]
    register(spark, lambda p: ("yes" if "ann" in p else "no", 0, 0))
    assert spark.sql("SELECT count(*) FROM people WHERE ai_if(concat('is it ', name))").first()[0] == 1


def test_registry_chooses_by_policy(spark):
    r = ModelRegistry()
    r.create_model("good", ExpressionModel(spec=ModelSpec("good", 2, 0, 5, 0.9)))
    r.create_model("cheap", ExpressionModel(spec=ModelSpec("cheap", 0.1, 0, 0.2, 0.5)))
    assert r.choose("max_quality").spec.name == "good" and r.choose("min_cost").spec.name == "cheap"
    with pytest.raises(LookupError):
        r.choose(modality="image")
    assert r.create_prompt("p", "is {x} so").slots == [("x", None)] and r.prices(spark).count() == 2


def test_template_questions_and_new_rows(spark, people):
    out = sem.answer_templates(people, "How good is <name>?", ExpressionModel({"How good is {name}?": lambda c: F.length(c)}), "n")
    assert out.count() == 4 and out.columns == ["id", "name", "score", "n"]
    assert sem.new_only(people.filter("id = 1"), people, "id").count() == 2


def test_early_stop_and_budget(spark, people, tmp_path):
    path = str(tmp_path / "asked")

    def client(prompt):
        with open(path, "a") as f:
            f.write("x")
        return ("true", 1, 1)

    many = spark.range(5000).coalesce(1).withColumn("name", F.lit("n"))
    model = RemoteModel(client, ModelSpec("fake"), workers=4)
    assert sem.sem_filter_any(many, "{id} is a number", model, 3).count() == 3
    with open(path) as f:
        assert len(f.read()) <= 8
    assert sem.sem_filter_any(people, LONG, MODEL, 1).count() == 1
    some = sem.within_budget(many, "id", LONG, ExpressionModel({LONG: lambda c: F.length(c) > 0}), "ok", 100)
    assert some.filter("ok_asked").count() == some.filter("ok").count() == 100 and some.count() == 5000
