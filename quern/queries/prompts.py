"""Prompts over many rows, pairs and labels: reduction, comparison, typed generation, SQL calls, modalities and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.datagen.scaling import children, repair, sample, sample_with
from quern.evaluation import metrics as ev
from quern.functions.prompts import parse_boolean
from quern.functions.sql import sem_sql
from quern.models.base import ExpressionModel, ModelSpec
from quern.operators import semantic as sem
from quern.queries.registry import Book
from quern.streaming.ingest import unit_vector
from quern.tables import table

query = Book()

MOOD = "Are the reviews {reviewText} of the movie mostly positive or negative?"
GENRES = "Which genres does the movie {title} have, given {genre}?"
BETTER = "A review with the mark {mark:left} praises its movie more than one with {mark:right}"
WORDS = "Describe the product {p_name} by its colour and number of words"
FUEL = "Which kind of drive does a car with {fuel_type} have?"
OLD = "Is the car {car_id} old? Answer in a sentence."

GOLD = ExpressionModel(
    {
        MOOD: lambda *_: F.when(2 * F.count_if(F.col("scoreSentiment") == "POSITIVE") >= F.count("scoreSentiment"), "POSITIVE").otherwise("NEGATIVE"),
        GENRES: lambda _, genre: F.to_json(F.transform(F.split(genre, ","), lambda x: F.trim(x))),
        BETTER: lambda a, b: a > b,
        WORDS: lambda name: F.to_json(F.struct(F.split_part(name, F.lit(" "), F.lit(1)).alias("colour"), F.size(F.split(name, " ")).alias("words"))),
        FUEL: lambda fuel: F.lower(fuel),
        OLD: lambda *_: F.when(F.col("year") < 2005, "Yes, it is old.").when(F.col("year") >= 2005, "No, it is rather new."),
    },
    ModelSpec("gold"),
)
LABELS = {"gasoline": "burns petrol", "diesel": "burns diesel oil", "electric": "has a battery only"}
MARK = "try_cast(regexp_extract(originalScore, '^([0-9.]+)/5$', 1) AS DOUBLE)"


@query("""SELECT id, CASE WHEN 2 * count(*) FILTER (WHERE scoreSentiment = 'POSITIVE') >= count(scoreSentiment) THEN 'POSITIVE' ELSE 'NEGATIVE' END AS mood FROM reviews WHERE id IS NOT NULL GROUP BY id""")
def sem_reduce_by_movie(spark: SparkSession, d: str) -> DataFrame:
    """One answer about all reviews of each movie."""
    return sem.sem_reduce(table(spark, d, "reviews").filter("id IS NOT NULL"), MOOD, GOLD, "mood", ["id"])


@query("""WITH g AS (SELECT DISTINCT director, title, trim(unnest(string_split(genre, ','))) AS genre FROM movies WHERE director IS NOT NULL AND title IS NOT NULL),
    n AS (SELECT director, count(DISTINCT title) AS n FROM movies WHERE director IS NOT NULL AND title IS NOT NULL GROUP BY director)
    SELECT g.director, g.genre FROM g JOIN n USING (director) GROUP BY g.director, g.genre, n.n HAVING count(DISTINCT title) = n.n""")
def sem_common_genres(spark: SparkSession, d: str) -> DataFrame:
    """The genres that all movies of a director share: a list per movie from the model, then what is in all of them."""
    movies = table(spark, d, "movies").select("director", "title", "genre").filter("director IS NOT NULL AND title IS NOT NULL")
    return sem.sem_common(movies, GENRES, GOLD, "title", "genre", ["director"]).select("director", "genre")


@query(f"""WITH t AS (SELECT reviewId, max({MARK}) AS mark FROM reviews WHERE reviewId IS NOT NULL GROUP BY reviewId HAVING mark IS NOT NULL ORDER BY mark DESC, reviewId LIMIT 25)
    SELECT reviewId, mark, rank() OVER (ORDER BY mark DESC) AS "rank" FROM t""")
def sem_topk_compare(spark: SparkSession, d: str) -> DataFrame:
    """The 25 best reviews by a model that compares two at a time."""
    marks = table(spark, d, "reviews").filter("reviewId IS NOT NULL").groupBy("reviewId").agg(F.max(F.expr(MARK)).alias("mark")).filter("mark IS NOT NULL")
    return sem.sem_topk_by(marks, BETTER, GOLD, 25, "reviewId")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS words FROM part")
def sem_generate_typed(spark: SparkSession, d: str) -> DataFrame:
    """An answer in JSON, read by a schema into typed columns."""
    return sem.sem_generate(table(spark, d, "part").select("p_partkey", "p_name"), WORDS, GOLD, "colour string, words int").select("p_partkey", "colour", "words")


@query("SELECT car_id, CASE WHEN lower(fuel_type) IN ('gasoline', 'diesel', 'electric') THEN lower(fuel_type) END AS drive FROM cars")
def sem_classify_described(spark: SparkSession, d: str) -> DataFrame:
    """Classes that are told with descriptions."""
    return sem.sem_classify(table(spark, d, "cars"), FUEL, LABELS, GOLD, "drive").select("car_id", "drive")


@query("SELECT drive, count(*) AS n FROM (SELECT CASE WHEN lower(fuel_type) IN ('gasoline', 'diesel') THEN lower(fuel_type) END AS drive FROM cars) GROUP BY drive")
def sem_sql_classify(spark: SparkSession, d: str) -> DataFrame:
    """AI_CLASSIFY with its labels in SQL text."""
    table(spark, d, "cars").createOrReplaceTempView("quern_cars")
    return sem_sql(spark, "SELECT drive, count(*) AS n FROM (SELECT AI_CLASSIFY('What drives it?', fuel_type, ARRAY('gasoline', 'diesel')) AS drive FROM quern_cars) GROUP BY drive", {"What drives it?": "lower($1)"})


@query("SELECT DISTINCT c.car_id FROM cars c JOIN car_images i ON c.car_id = i.car_id WHERE i.damage_status <> 'no_damage' AND c.year < 2005")
def sem_sql_join(spark: SparkSession, d: str) -> DataFrame:
    """A join whose condition is a prompt over both sides, beside the key."""
    for name in ("cars", "car_images"):
        table(spark, d, name).createOrReplaceTempView(f"quern_{name}")
    text = "SELECT DISTINCT c.car_id FROM quern_cars c JOIN quern_car_images i ON c.car_id = i.car_id AND AI_JOIN('An old car and a picture of damage', c.year, i.damage_status)"
    return sem_sql(spark, text, {"An old car and a picture of damage": "$1 < 2005 AND $2 <> 'no_damage'"})


@query("SELECT id, max(CASE WHEN scoreSentiment = 'POSITIVE' THEN 'liked' ELSE 'disliked' END) AS verdict FROM reviews WHERE id IS NOT NULL GROUP BY id")
def sem_sql_reduce(spark: SparkSession, d: str) -> DataFrame:
    """AI_REDUCE over the rows of a group."""
    table(spark, d, "reviews").createOrReplaceTempView("quern_reviews")
    answers = {"Did anyone like it?": "max(CASE WHEN $1 = 'POSITIVE' THEN 'liked' ELSE 'disliked' END)"}
    return sem_sql(spark, "SELECT id, AI_REDUCE('Did anyone like it?', scoreSentiment) AS verdict FROM quern_reviews WHERE id IS NOT NULL GROUP BY id", answers)


@query("SELECT car_id, CASE WHEN year < 2005 THEN true WHEN year >= 2005 THEN false END AS old FROM cars")
def sem_generate_boolean(spark: SparkSession, d: str) -> DataFrame:
    """A generated sentence read as a yes or a no."""
    return sem.sem_map(table(spark, d, "cars"), OLD, GOLD, "said").select("car_id", parse_boolean(F.col("said")).alias("old"))


@query('SELECT l_returnflag, count(l_comment) AS "count(l_comment)", avg(l_quantity) AS "average(l_quantity)" FROM (SELECT *, l_shipdate AS l_comment FROM lineitem) GROUP BY l_returnflag')
def group_by_signature(spark: SparkSession, d: str) -> DataFrame:
    """Groups with functions and fields given as lists, and columns named after them."""
    rows = table(spark, d, "lineitem").withColumn("l_comment", F.col("l_shipdate"))
    return sem.group_by_signature(rows, ["l_returnflag"], ["count", "average"], ["l_comment", "l_quantity"])


@query("""SELECT c.car_id FROM cars c WHERE (CASE WHEN EXISTS (SELECT 1 FROM car_images i WHERE i.car_id = c.car_id) THEN 1 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM complaints t WHERE t.car_id = c.car_id) THEN 1 ELSE 0 END + CASE WHEN c.vin IS NOT NULL THEN 1 ELSE 0 END) >= 2""")
def filter_several_modalities(spark: SparkSession, d: str) -> DataFrame:
    """Cars with at least two of pictures, complaints and papers; each modality is one flag a car before the join."""
    cars = table(spark, d, "cars").select("car_id", "vin")
    for name, flag in (("car_images", "seen"), ("complaints", "told")):
        cars = cars.join(table(spark, d, name).groupBy("car_id").agg(F.lit(True).alias(flag)), "car_id", "left")
    return cars.filter(sem.several_of([F.col("seen"), F.col("told"), F.col("vin").isNotNull()], 2)).select("car_id")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) >= 3000")
def filter_text_length(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 3,000 characters or more."""
    docs = table(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n_chars"))
    return docs.filter("n_chars >= 3000")


@query("SELECT reviewId FROM reviews WHERE starts_with(reviewText, 'The ') AND contains(reviewText, 'film') GROUP BY reviewId")
def filter_prefix_contains(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that begin with one word and hold another."""
    return table(spark, d, "reviews").filter(F.col("reviewText").startswith("The ") & F.col("reviewText").contains("film")).select("reviewId").distinct()


@query("SELECT n_name, n_regionkey, n_nationkey FROM nation")
def project_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Columns in another order."""
    return table(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / {_NORM}, 6) AS first, round(CAST(embedding[64] AS DOUBLE) / {_NORM}, 6) AS last FROM embeddings WHERE {_NORM} > 0")
def embedding_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as an ingest keeps them, at length 1."""
    unit = table(spark, d, "embeddings").select("vec_id", unit_vector(F.col("embedding")).alias("u")).filter("u IS NOT NULL")
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


# What a system found, against the gold, for the scores below.
_FOUND, _TRUE = "(SELECT DISTINCT car_id FROM car_images WHERE damage_status LIKE '%dent%' AND car_id IS NOT NULL)", "(SELECT DISTINCT car_id FROM complaints WHERE crash AND car_id IS NOT NULL)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = table(spark, d, "car_images").filter("damage_status LIKE '%dent%' AND car_id IS NOT NULL").select("car_id").distinct()
    return found, table(spark, d, "complaints").filter("crash AND car_id IS NOT NULL").select("car_id").distinct()


_N = f"(SELECT count(*) AS tp FROM {_FOUND} JOIN {_TRUE} USING (car_id)), (SELECT count(*) AS r FROM {_FOUND}), (SELECT count(*) AS g FROM {_TRUE})"


@query(f"SELECT tp / r AS precision, tp / least(g, 100000) AS recall, 2 * (tp / r) * (tp / least(g, 100000)) / (tp / r + tp / least(g, 100000)) AS f1_score FROM {_N}")
def eval_padded_prf(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an any-n query against a gold that is filled up to the limit."""
    return ev.padded(*_sides(spark, d), "car_id", 100_000)


@query(f"SELECT 2 * (tp / r) * (tp / g) / (tp / r + tp / g) AS value FROM {_N}")
def eval_by_name(spark: SparkSession, d: str) -> DataFrame:
    """A score chosen by its name."""
    return ev.evaluate("f1-score", *_sides(spark, d), "car_id")


@query(f"SELECT count(*) FILTER (WHERE car_id IN (SELECT car_id FROM {_TRUE})) / count(*) AS precision FROM car_images WHERE car_id IS NOT NULL")
def eval_list_hits(spark: SparkSession, d: str) -> DataFrame:
    """The share of listed rows, repeated ones too, that are in the gold."""
    listed = table(spark, d, "car_images").filter("car_id IS NOT NULL").select("car_id")
    return ev.list_hits(listed, _sides(spark, d)[1], "car_id").select("precision")


@query("SELECT 1::DOUBLE AS precision, 1::DOUBLE AS recall, 1::DOUBLE AS f1_score")
def eval_top_choice(spark: SparkSession, d: str) -> DataFrame:
    """One answer among several that are tied for the best."""
    n = table(spark, d, "car_images").filter("car_id IS NOT NULL").groupBy("car_id").count()
    tied = n.join(n.agg(F.max("count").alias("count")), "count")
    return ev.top_choice(tied.orderBy("car_id").limit(1), tied, "car_id")


@query("SELECT o_orderstatus AS query, round(CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 1 / (1 + 0.25) ELSE 0.0 END, 6) AS quality FROM orders GROUP BY o_orderstatus")
def eval_quality(spark: SparkSession, d: str) -> DataFrame:
    """One number of quality whatever the kind of score."""
    q = table(spark, d, "orders").select(F.col("o_orderstatus").alias("query")).distinct()
    of = lambda s, v: F.when(F.col("query") == s, F.lit(v))
    scores = q.select("query", of("F", 0.5).alias("f1_score"), of("O", 0.25).alias("relative_error"), F.when(~F.col("query").isin("F", "O"), F.lit(-0.3)).alias("spearman_correlation"))
    return ev.quality(scores).select("query", F.round("quality", 6).alias("quality"))


@query("SELECT l_linestatus AS query FROM lineitem GROUP BY l_linestatus HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def eval_common_queries(spark: SparkSession, d: str) -> DataFrame:
    """The queries that every system answered: here line states with every flag."""
    return ev.common(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("query"), "l_returnflag"), "query", "l_returnflag")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS strays FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scale_children(spark: SparkSession, d: str) -> DataFrame:
    """The rows that belong to a choice of parents."""
    parents = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    rows = children(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), parents, "c_custkey")
    return rows.join(parents.select("c_custkey", F.lit(1).alias("_p")), "c_custkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p").isNull()).alias("strays"))


@query("SELECT 100 AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = 3) AS n_must, true AS all_known FROM range(1)")
def scale_sample_with(spark: SparkSession, d: str) -> DataFrame:
    """A sample that must hold some rows: its size, how many of these, and whether all are rows of the table."""
    parts = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.lit(-1).alias("s_nationkey")))
    got = sample_with(parts, "s_suppkey", F.col("s_nationkey") == 3, 100)
    return got.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("s_nationkey") == 3).alias("n_must"), F.lit(True).alias("all_known"))


@query("SELECT least(500, count(*)) AS n, true AS distinct_keys FROM (SELECT o_orderkey FROM orders)")
def scale_sample_size(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample has the rows asked for, each once, and is the same again."""
    orders = table(spark, d, "orders").select("o_orderkey")
    one, again = sample(orders, "o_orderkey", 500), sample(orders, "o_orderkey", 500)
    both = one.join(again, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("u"))
    return both.select("n", (F.col("n") == F.col("u")).alias("distinct_keys"))


@query("SELECT car_id, CASE WHEN car_id = (SELECT min(car_id) FROM cars WHERE fuel_type = 'Electric') THEN 'Steam' ELSE fuel_type END AS fuel_type FROM cars")
def scale_repair(spark: SparkSession, d: str) -> DataFrame:
    """A value that no row of some kind has is given to the first of them."""
    cars = table(spark, d, "cars").select("car_id", "fuel_type")
    return repair(cars, "car_id", "fuel_type", [(F.col("fuel_type") == "Electric", "Steam")])


QUERIES, ORACLE = query.queries, query.oracle
