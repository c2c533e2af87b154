import json
import math

import pytest
from pyspark.sql import functions as F

from quern.catalog import Catalog, describe, lookup, value_index, visible
from quern.datagen import scaling
from quern.evaluation import metrics as ev
from quern.models.base import ExpressionModel, ModelRegistry
from quern.plans.plan import Filter, Join, Rel, Scan, SemFilter, in_all, optimise, run, shared_nodes
from quern.plans.steps import PlanError, attempt, check_expression, execute
from quern.sources import readers, writers
from quern.streaming.ingest import ingest_new, windowed_counts


def one(df):
    return tuple(df.first())


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_retrieval_metrics(spark):
    a, none = ids(spark, "x", "y", "y"), ids(spark)
    assert one(ev.retrieval(a, a)) == (1.0, 1.0, 1.0)
    assert one(ev.retrieval(none, none)) == (1.0, 0.0, 0.0)
    assert one(ev.retrieval(a, ids(spark, "y"))) == (pytest.approx(1 / 3), 1.0, 0.5)
    assert one(ev.retrieval(ids(spark, None), ids(spark, "z"))) == (1.0, 1.0, 1.0)
    assert one(ev.id_set(none, none, "id")) == (1.0, 1.0, 1.0)
    assert one(ev.id_set(a, none, "id")) == (0.0, 0.0, 0.0)
    assert one(ev.limited(ids(spark, *"abcde"), ids(spark, *"abcdefghijklmn"), "id", 5)) == (1.0, 1.0, 1.0)
    pairs = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    assert one(ev.tuples(pairs(("b", "a")), pairs(("a", "b")), ["a", "b"])) == (1.0, 1.0, 1.0)
    assert one(ev.tuples(a, pairs(("a", "b")), ["a", "b"])) == (0.0, 0.0, 0.0)
    assert one(ev.top_choice(ids(spark, "x"), ids(spark, "x", "y"), "id"))[0] == 1.0
    assert one(ev.top_choice(ids(spark, "x", "y"), ids(spark, "x", "y"), "id"))[0] == 0.0
    assert one(ev.list_hits(a, ids(spark, "y"), "id"))[0] == pytest.approx(2 / 3)


def test_aggregate_metrics(spark):
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "v string")
    assert one(ev.aggregate_error(v("14"), "v", 14.0)) == (0.0, 0.0, 0.0)
    assert one(ev.aggregate_error(v("1", "2"), "v", 14.0)) == (math.inf, 1.0, 100.0)
    assert one(ev.aggregate_error(v("3"), "v", 0.0))[1] == math.inf
    g = lambda **k: spark.createDataFrame(list(k.items()), "k string, n int")
    assert one(ev.group_count_error(g(a=10), g(a=10, b=5), "k", "n"))[0] == 0.5


def test_rank_and_cluster_metrics(spark):
    s = lambda *x: spark.createDataFrame(list(enumerate(x)), "id int, v double")
    assert one(ev.spearman(s(1.0, 2.0, 3.0), s(1.0, 5.0, 9.0), "id", "v"))[0] == pytest.approx(1)
    assert one(ev.kendall(s(1.0, 2.0, 3.0), s(9.0, 5.0, 1.0), "id", "v"))[0] == pytest.approx(-1)
    assert one(ev.kendall(s(1.0, 1.0, 2.0, 3.0), s(1.0, 2.0, 2.0, 3.0), "id", "v"))[0] == pytest.approx(0.8)
    assert one(ev.spearman(s(1.0), s(1.0), "id", "v"))[0] == 0 and one(ev.kendall(s(1.0), s(1.0), "id", "v"))[0] == 0
    c = lambda *x: spark.createDataFrame(list(enumerate(x)), "id int, label string")
    assert one(ev.adjusted_rand(c("a", "a", "b", "b"), c("x", "x", "y", "y"), "id", "label"))[0] == pytest.approx(1)
    assert one(ev.omega_index(c("a", "a", "b", None), c("x", "x", "y", "z"), "id", "label"))[0] == pytest.approx(1)
    p, q = c("a", "b", "b", "a", "c"), c("a", "a", "b", "b", "c")
    assert one(ev.adjusted_rand(p, q, "id", "label")) == pytest.approx(one(ev.adjusted_rand(q, p, "id", "label")))
    assert one(ev.macro_f1(p, q, "id", "label")) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 0.6))
    assert one(ev.evaluate("f1-score", p.select("id"), q.select("id"), "id"))[0] == 1.0
    with pytest.raises(ValueError, match="unknown"):
        ev.evaluate("bleu", p, q, "id")


def test_costs_wins_and_fronts(spark):
    runs = spark.createDataFrame([("q", "a", 1.0, 0.9), ("q", "b", 2.0, 0.9), ("q", "c", 0.5, 0.5)], "query string, system string, cost double, quality double")
    assert sorted(r["system"] for r in ev.pareto(runs, ["query"], "system", "cost", "quality").collect()) == ["a", "c"]
    assert {r["system"]: r["wins"] for r in ev.wins(runs, ["query"], "system", "quality").collect()} == {"a": 0.5, "b": 0.5}
    assert ev.common(runs, "query", "system").count() == 1
    usage = spark.createDataFrame([("m", 1000000, 0, 1000000, None), ("other", 1, 1, 1, 1)], "model string, text_tokens long, audio_tokens long, output_tokens long, reasoning_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 2.0, 4.0)], "model string, text double, audio double, output double")
    assert {r["model"]: r["money_cost"] for r in ev.cost(usage, prices).collect()} == {"m": 5.0, "other": None}
    m = spark.createDataFrame([(0.5, None, None), (None, 1.0, None), (None, None, -0.5)], "f1_score double, relative_error double, spearman_correlation double")
    assert [r["quality"] for r in ev.quality(m).collect()] == [0.5, 0.5, 0.0]


def test_catalogue(spark):
    c = Catalog()
    c.add("orders", spark.createDataFrame([(1, 7)], "o int, cust int"))
    c.add("customer", spark.createDataFrame([(7, 3, "x")], "c int, nation int, o string"))
    c.add("nation", spark.createDataFrame([(3, "FR")], "n int, name string"))
    c.link("orders", "cust", "customer", "c")
    c.link("customer", "nation", "nation", "n")
    assert c.joined("orders", "nation").columns == ["o", "cust", "nation", "name"]
    assert c.join_path("orders", "nowhere") is None
    with pytest.raises(KeyError, match="customer"):
        c.table("custmer")
    with pytest.raises(ValueError, match="empty"):
        c.put("none", c.table("nation").limit(0), strict_empty=True)
    df = describe(c.table("nation"), {"name": "TEXT"}, ["n"])
    assert visible(df).columns == ["name"] and df.schema["name"].metadata["modality"] == "TEXT"
    index = value_index(ids(spark, "Berlin", "Bern", "Paris", None), "id")
    assert lookup(index, ids(spark, "berlin city").withColumnRenamed("id", "asked"), "asked", 1).first()["value"] == "Berlin"


def test_plans(spark):
    df = spark.range(10).withColumn("t", F.col("id").cast("string"))
    model = ExpressionModel({"{t} is even": lambda c: c.cast("int") % 2 == 0, "{t} is small": lambda c: c.cast("int") < 6})
    dear, cheap = SemFilter([Scan(df=df)], "{t} is even", model, price=9.0), None
    cheap = SemFilter([dear], "{t} is small", model, price=1.0)
    top = optimise(Filter([cheap], F.col("id") > 1))
    order = [type(top).__name__, getattr(top, "price", None), top.inputs[0].price, type(top.inputs[0].inputs[0]).__name__]
    assert order == ["SemFilter", 9.0, 1.0, "Filter"]
    assert [r["id"] for r in run(top).collect()] == [2, 4]
    joined = optimise(Join([SemFilter([Scan(df=df)], "{t} is even", model), Scan(df=spark.range(3))], on=[("id", "id")], selective=True))
    assert isinstance(joined, SemFilter) and sorted(r["id"] for r in run(joined).collect()) == [0, 2]
    both = Rel([top, top], step=lambda a, b: a.unionByName(b))
    assert len(shared_nodes(both)) == 1 and run(both).count() == 4
    assert [r[0] for r in in_all("id", df, df.filter("id < 2"), spark.range(1)).collect()] == [0]


def test_json_steps(spark):
    c, r = Catalog(), ModelRegistry()
    c.add("t", spark.createDataFrame([(1, " A "), (2, "b")], "id int, name string"))
    steps = [{"tool": "transform", "inputs": ["t"], "output": "u", "arguments": {"column": "low", "expression": "lower(trim(name))"}}, {"tool": "check", "output": "u"}]
    assert [x["low"] for x in execute(json.dumps(steps), c, r).orderBy("id").collect()] == ["a", "b"]
    for bad, phase in (("nonsense", "planning"), ([{"tool": "dance", "output": "x"}], "mapping"), ([{"tool": "noop", "inputs": ["zz"], "output": "x"}], "discovery")):
        with pytest.raises(PlanError) as e:
            execute(bad if isinstance(bad, str) else json.dumps(bad), c, r)
        assert e.value.phase == phase
    with pytest.raises(ValueError, match="reflect"):
        check_expression("reflect('java.lang.System', 'exit')")
    asked = []
    planner = lambda told: asked.append(list(told)) or ("broken" if not told else json.dumps(steps))
    assert attempt(planner, c, r).count() == 2 and len(asked) == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,z\nbad\n')
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string", skip_errors=True).count() >= 2
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"data": {"id": k, "n": {"m": "v"}}}))
        (tmp_path / f"{k}.txt").write_text(f"text {k}\nmore")
        (tmp_path / f"{k}.png").write_bytes(bytes([137, 80, k]))
    (tmp_path / "s.wav").write_bytes(b"RIFF")
    assert readers.read_json_folder(spark, str(tmp_path / "*.json"), "data").select("n.m").distinct().count() == 1
    assert readers.read_texts(spark, str(tmp_path)).count() == 2 and readers.read_sounds(spark, str(tmp_path)).count() == 1
    images = readers.read_images(spark, str(tmp_path))
    paths = spark.createDataFrame([("dir/0.png",), ("dir/9.png",)], "p string")
    assert readers.with_files(paths, "p", images).filter("n_bytes IS NOT NULL").count() == 1
    readers.register_iterator(spark, "squares", "n int, sq int", 7, lambda k: (k, k * k))
    assert spark.read.format("squares").load().agg(F.sum("sq")).first()[0] == 91
    m = spark.createDataFrame([("q1", 1.0)], "query string, f double")
    writers.merge_metrics(m, str(tmp_path / "m"), ["query"])
    writers.merge_metrics(spark.createDataFrame([("q1", 2.0), ("q2", 3.0)], "query string, f double"), str(tmp_path / "m"), ["query"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("q1", 2.0), ("q2", 3.0)]
    assert writers.load_if_changed(spark, m, str(tmp_path / "t")) and not writers.load_if_changed(spark, m, str(tmp_path / "t"))
    assert writers.load_if_changed(spark, m.unionByName(m), str(tmp_path / "t"))
    writers.write_result(m, str(tmp_path / "r"), single=True)
    writers.write_table(m, str(tmp_path / "p"), ["query"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_scaling(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 70, "a").when(F.col("id") < 95, "b").alias("g"))
    assert [r[0] for r in scaling.sample(df, "id", 5).collect()] == [r[0] for r in scaling.sample(df.repartition(7), "id", 5).collect()]
    assert scaling.sample_with(df, "id", F.col("id") == 3, 5).filter("id = 3").count() == 1
    with pytest.raises(ValueError, match="70"):
        scaling.sample_with(df, "id", F.col("g") == "a", 5)
    counts = {r["g"]: r["count"] for r in scaling.stratified(df, "id", "g", 20).groupBy("g").count().collect()}
    assert counts == {"a": 14, "b": 5, None: 1}
    assert scaling.children(df, df.filter("id < 3"), "id").count() == 3
    assert scaling.capped_by_group(df, "g", "id", 1, 90).count() == 5
    placed = scaling.assign(df, "id", {"x": 1.0, "y": 0.0}, "p")
    assert placed.filter("p = 'y'").count() == 0
    fixed = scaling.repair(placed, "id", "p", [(F.col("g") == "b", "z")])
    assert [r["id"] for r in fixed.filter("p = 'z'").collect()] == [70]
    assert scaling.denormalise(df, "id", df.select("id", F.lit(1).alias("n")), df.limit(0).select("id", F.lit(1).alias("m"))).count() == 100
    assert scaling.shuffle(df, "id").count() == 100


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string").write.parquet(str(tmp_path / "in"))

    def ingest():
        stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
        ingest_new(stream, "id", str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.withColumn("w", F.upper("v"))).awaitTermination()

    ingest()
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    ingest()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]
    events = spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'x' AS kind UNION ALL SELECT TIMESTAMP '2024-01-01 00:50:00', 'x'")
    assert windowed_counts(events, "ts", "kind", "1 hour").first()["n"] == 2
