"""Evaluation of results against gold answers, costs, wins, and scaled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.datagen import scaling
from quern.evaluation import metrics as ev
from quern.models.base import ExpressionModel, ModelRegistry, ModelSpec
from quern.queries.registry import Book
from quern.tables import table

query = Book()


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").filter("reviewId IS NOT NULL")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """A simple model's classes: fresh reviews are positive."""
    label = F.when(F.col("reviewState") == "fresh", "POSITIVE").otherwise("NEGATIVE")
    return _reviews(spark, d).groupBy("reviewId").agg(F.min(label).alias("label"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).groupBy("reviewId").agg(F.min("scoreSentiment").alias("label"))


_PG = """p AS (SELECT reviewId, min(CASE WHEN reviewState = 'fresh' THEN 'POSITIVE' ELSE 'NEGATIVE' END) AS label FROM reviews WHERE reviewId IS NOT NULL GROUP BY 1),
    g AS (SELECT reviewId, min(scoreSentiment) AS label FROM reviews WHERE reviewId IS NOT NULL GROUP BY 1)"""
_PRF = "SELECT tp / r AS precision, tp / g AS recall, 2 * (tp / r) * (tp / g) / (tp / r + tp / g) AS f1_score FROM ({})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


def _sql_rounded(sql: str, *columns: str) -> str:
    return f"WITH {_PG} SELECT {', '.join(f'round({c}, 9) AS {c}' for c in columns)} FROM ({sql})"


_SETS = """SELECT (SELECT count(*) FROM p JOIN g USING (reviewId) WHERE p.label = 'POSITIVE' AND g.label = 'POSITIVE') AS tp,
    (SELECT count(*) FROM p WHERE label = 'POSITIVE') AS r, (SELECT count(*) FROM g WHERE label = 'POSITIVE') AS g"""


@query(_sql_rounded(_PRF.format(_SETS), "precision", "recall", "f1_score"))
def eval_set_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the reviews found positive."""
    positive = lambda df: df.filter("label = 'POSITIVE'")
    return _rounded(ev.id_set(positive(_predicted(spark, d)), positive(_gold(spark, d)), "reviewId"))


@query(_sql_rounded(_PRF.format("SELECT count(*) FILTER (hit) AS tp, count(*) AS r, 100 AS g FROM (SELECT p.reviewId IN (SELECT reviewId FROM g WHERE label = 'POSITIVE') AS hit FROM p WHERE label = 'POSITIVE' ORDER BY p.reviewId LIMIT 100)"), "precision", "recall", "f1_score"))
def eval_limit_prf(spark: SparkSession, d: str) -> DataFrame:
    """The same for a query that asks for any hundred."""
    found = _predicted(spark, d).filter("label = 'POSITIVE'").orderBy("reviewId")
    return _rounded(ev.limited(found, _gold(spark, d).filter("label = 'POSITIVE'"), "reviewId", 100))


@query("""WITH a AS (SELECT DISTINCT least(c_nationkey, c_custkey % 25) AS x, greatest(c_nationkey, c_custkey % 25) AS y FROM customer),
    b AS (SELECT DISTINCT least(s_nationkey, s_suppkey % 25) AS x, greatest(s_nationkey, s_suppkey % 25) AS y FROM supplier),
    n AS (SELECT (SELECT count(*) FROM a SEMI JOIN b USING (x, y)) AS tp, (SELECT count(*) FROM a) AS r, (SELECT count(*) FROM b) AS g)
    SELECT round(tp / r, 9) AS precision, round(tp / g, 9) AS recall, round(2 * (tp / r) * (tp / g) / (tp / r + tp / g), 9) AS f1_score FROM n""")
def eval_pairs_prf(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose order doesn't matter."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("x"), F.pmod("c_custkey", F.lit(25)).alias("y"))
    b = table(spark, d, "supplier").select(F.pmod("s_suppkey", F.lit(25)).alias("x"), F.col("s_nationkey").cast("long").alias("y"))
    return _rounded(ev.tuples(a, b, ["x", "y"]))


@query("""SELECT round(abs(v - 2500), 6) AS absolute_error, round(abs(v - 2500) / 2500, 9) AS relative_error, round(abs(v - 2500) / 25, 7) AS mean_absolute_percentage_error
    FROM (SELECT count(*) AS v FROM car_images WHERE damage_status = 'no_damage')""")
def eval_agg_error(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a count against a stated one."""
    result = table(spark, d, "car_images").filter("damage_status = 'no_damage'").agg(F.count(F.lit(1)).alias("v"))
    e = ev.aggregate_error(result, "v", 2500.0)
    return e.select(F.round("absolute_error", 6).alias("absolute_error"), F.round("relative_error", 9).alias("relative_error"), F.round("mean_absolute_percentage_error", 7).alias("mean_absolute_percentage_error"))


@query(f"""WITH {_PG}, x AS (SELECT label, count(*) AS r FROM p WHERE label IS NOT NULL GROUP BY 1), y AS (SELECT label, count(*) AS g FROM g WHERE label IS NOT NULL GROUP BY 1)
    SELECT round(avg(abs(coalesce(r, 0) - coalesce(g, 0)) / g), 9) AS relative_error FROM x FULL JOIN y USING (label)""")
def eval_group_count_error(spark: SparkSession, d: str) -> DataFrame:
    """Mean relative error of the counts per class."""
    count = lambda df: df.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(ev.group_count_error(count(_predicted(spark, d)), count(_gold(spark, d)), "label", "n"))


_MOVIES = "SELECT id, CAST(tomatoMeter AS DOUBLE) AS a, CAST(audienceScore AS DOUBLE) AS b FROM movies WHERE tomatoMeter IS NOT NULL AND audienceScore IS NOT NULL"


def _ratings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    movies = table(spark, d, "movies")
    return movies.select("id", F.col("tomatoMeter").alias("score")), movies.select("id", F.col("audienceScore").alias("score"))


@query(f"""WITH m AS ({_MOVIES}), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM m)
    SELECT round(corr(ra, rb), 9) AS spearman_correlation FROM r""")
def eval_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of critics' and audience scores."""
    return _rounded(ev.spearman(*_ratings(spark, d), "id", "score"))


@query(f"""WITH c AS (SELECT a, b, count(*)::DOUBLE AS n FROM ({_MOVIES}) GROUP BY ALL), s AS (SELECT sum(sign(y.a - x.a) * sign(y.b - x.b) * x.n * y.n) / 2 AS s FROM c x, c y),
    t AS (SELECT (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS n0, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS ta, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS tb)
    SELECT round(s / sqrt((n0 - ta) * (n0 - tb)), 9) AS kendall_tau FROM s, t""")
def eval_kendall(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau of critics' and audience scores."""
    return _rounded(ev.kendall(*_ratings(spark, d), "id", "score"))


@query(f"""WITH {_PG}, b AS (SELECT g.label AS g, p.label AS r FROM g JOIN p USING (reviewId)), l AS (SELECT g AS l FROM b WHERE g IS NOT NULL UNION SELECT r FROM b WHERE r IS NOT NULL),
    c AS (SELECT l, count(*) FILTER (g = l AND r = l) AS tp, count(*) FILTER (r = l) AS nr, count(*) FILTER (g = l) AS ng FROM l, b GROUP BY l),
    m AS (SELECT coalesce(tp / nullif(nr, 0), 0) AS p, coalesce(tp / nullif(ng, 0), 0) AS r FROM c)
    SELECT round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 9) AS f1_score,
        round((SELECT avg(coalesce(g = r, FALSE)::INT) FROM b), 9) AS accuracy FROM m""")
def eval_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Macro scores of the classes."""
    return _rounded(ev.macro_f1(_predicted(spark, d), _gold(spark, d), "reviewId", "label"))


_CLUSTERS = "SELECT vec_id, label AS g, vec_id % 7 AS r FROM embeddings"


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.pmod("vec_id", F.lit(7)).alias("label")), v.select("vec_id", "label")


_CELLS = f"""c AS (SELECT g, r, count(*)::DOUBLE AS n FROM ({_CLUSTERS}) GROUP BY ALL), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS al,
    (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY g)) AS a, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY r)) AS b)"""


@query(f"WITH {_CELLS} SELECT round((ij - a * b / al) / ((a + b) / 2 - a * b / al), 9) AS adjusted_rand_index FROM t")
def eval_ari(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of a clustering."""
    return _rounded(ev.adjusted_rand(*_clusters(spark, d), "vec_id", "label"))


@query(f"WITH {_CELLS}, u AS (SELECT (ij + al - a - b + ij) / al AS o, (a * b + (al - a) * (al - b)) / (al * al) AS e FROM t) SELECT round((o - e) / (1 - e), 9) AS omega_index FROM u")
def eval_omega(spark: SparkSession, d: str) -> DataFrame:
    """Omega index of a clustering."""
    return _rounded(ev.omega_index(*_clusters(spark, d), "vec_id", "label"))


@query("""WITH r AS (SELECT title, genre FROM movies WHERE year(releaseDateTheaters) >= 2000 AND title IS NOT NULL AND genre IS NOT NULL), g AS (SELECT title, genre FROM movies WHERE year(releaseDateTheaters) >= 1990 AND title IS NOT NULL AND genre IS NOT NULL),
    a AS (SELECT *, row_number() OVER (PARTITION BY title, genre) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY title, genre) AS k FROM g),
    n AS (SELECT (SELECT count(*) FROM a JOIN b USING (title, genre, k)) AS tp, (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM g) AS g)
    SELECT round(tp / r, 9) AS precision, round(tp / g, 9) AS recall, round(2 * (tp / r) * (tp / g) / (tp / r + tp / g), 9) AS f1_score FROM n""")
def eval_rows_prf(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows matched one to one, repeated ones as often as both sides have them."""
    movies = table(spark, d, "movies").filter("title IS NOT NULL AND genre IS NOT NULL")
    since = lambda y: movies.filter(F.year("releaseDateTheaters") >= y).select("title", "genre")
    return _rounded(ev.retrieval(since(2000), since(1990)))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of five systems (priorities) on many queries (clerks' days): cost and quality from the orders."""
    orders = table(spark, d, "orders")
    return orders.groupBy(F.month("o_orderdate").alias("query"), F.col("o_orderpriority").alias("system")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("cost"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("quality")
    )


_RUNS = "r AS (SELECT month(o_orderdate) AS query, o_orderpriority AS system, round(avg(o_totalprice), 4) AS cost, round(avg((o_orderstatus = 'F')::INT), 6) AS quality FROM orders GROUP BY ALL)"


@query(f"""WITH {_RUNS} SELECT query, system, cost, quality FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.query = a.query AND b.cost <= a.cost AND b.quality >= a.quality
    AND (b.cost < a.cost OR b.quality > a.quality))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """The systems per query that none beats in both cost and quality."""
    return ev.pareto(_runs(spark, d), ["query"], "system", "cost", "quality")


@query(f"""WITH {_RUNS}, b AS (SELECT *, max(quality) OVER (PARTITION BY query) AS m FROM r), t AS (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM b WHERE abs(quality - m) <= 0.02 * abs(m))
    SELECT system, round(sum(1 / n), 9) AS wins FROM t GROUP BY system""")
def win_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each system is best, ties within two hundredths shared."""
    return ev.wins(_runs(spark, d), ["query"], "system", "quality", 0.02).select("system", F.round("wins", 9).alias("wins"))


@query(f"WITH {_RUNS} SELECT system, round(avg(quality), 6) AS mean, round(stddev(quality), 6) AS std, count(*) AS n FROM r GROUP BY system")
def eval_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation over repeated runs."""
    out = ev.repeats(_runs(spark, d), ["system"], "quality")
    return out.select("system", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("""WITH u AS (SELECT CASE WHEN kind IN ('film', 'prod') THEN 'large' ELSE 'small' END AS model, n_chars AS i, 10 AS o FROM documents)
    SELECT model, round(sum((i * p.text + o * p.output) / 1000000), 9) AS money_cost, CAST(sum(i) AS BIGINT) AS text_tokens FROM u JOIN (VALUES ('large', 1.25, 10.0), ('small', 0.1, 0.4)) p(m, text, output) ON p.m = model GROUP BY model""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Costs by model from token counts and prices."""
    registry = ModelRegistry()
    registry.create_model("large", ExpressionModel(spec=ModelSpec("large", 1.25, 1.0, 10.0)))
    registry.create_model("small", ExpressionModel(spec=ModelSpec("small", 0.1, 0.3, 0.4, quality=0.8)))
    model = F.when(F.col("kind").isin("film", "prod"), "large").otherwise("small").alias("model")
    usage = table(spark, d, "documents").select(model, F.col("n_chars").alias("text_tokens"), F.lit(0).cast("long").alias("audio_tokens"), F.lit(10).cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("reasoning_tokens"))
    per = usage.groupBy("model").agg(*[F.sum(c).alias(c) for c in usage.columns[1:]])  # the cost is linear: tokens are summed before prices are joined
    return ev.cost(per, registry.prices(spark)).select("model", F.round("money_cost", 9).alias("money_cost"), "text_tokens")


@query()
def sample_seeded(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of movies with their reviews counted."""
    movies = scaling.sample(table(spark, d, "movies"), "id", 100)
    reviews = scaling.children(table(spark, d, "reviews"), movies, "id")
    return reviews.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
    q AS (SELECT c_mktsegment, least(300, total) * n / total AS x FROM c, t), f AS (SELECT c_mktsegment, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, c_mktsegment) <= (SELECT sum(x) - sum(floor(x)) FROM q) + 0.001)::INT AS n FROM q)
    SELECT c_mktsegment, CAST(n AS BIGINT) AS n FROM f""")
def scale_down_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Three hundred customers that keep the shares of the segments."""
    small = scaling.stratified(table(spark, d, "customer"), "c_custkey", "c_mktsegment", 300)
    return small.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query()
def assign_weighted(spark: SparkSession, d: str) -> DataFrame:
    """A place for every image by weight and a seeded chance."""
    placed = scaling.assign(table(spark, d, "car_images").select("image_id").distinct(), "image_id", {"north": 0.5, "south": 0.3, "west": 0.2}, "place")
    return placed.groupBy("place").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = query.queries, query.oracle
