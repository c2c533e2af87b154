"""Reviews of movies: filters, ratios, pairs, classes, scores and ranks by prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.sql import sem_sql
from quern.models.base import ExpressionModel, ModelSpec
from quern.operators import semantic as sem
from quern.queries.registry import Book
from quern.tables import table

query = Book()

POSITIVE = "The following movie review is clearly positive: {reviewText}"
SAME = "These two movie reviews express the same sentiment: {reviewText:left} / {reviewText:right}"
OPPOSITE = "These two movie reviews express opposite sentiments: {reviewText:left} / {reviewText:right}"
SENTIMENT = "Classify the sentiment of this review as POSITIVE or NEGATIVE: {reviewText}"
SCORE = "Score from 1 to 5 how much the critic liked the movie: {reviewText}"
PRAISE = "The review calls something in the film charming, moving or thrilling: {reviewText}"

#: The gold model reads the hidden label.
GOLD = ExpressionModel(
    {
        POSITIVE: lambda *_: F.col("scoreSentiment") == "POSITIVE",
        SAME: lambda *_: F.col("scoreSentiment_left") == F.col("scoreSentiment_right"),
        OPPOSITE: lambda *_: F.col("scoreSentiment_left") != F.col("scoreSentiment_right"),
        SENTIMENT: lambda *_: F.col("scoreSentiment"),
    },
    ModelSpec("gold"),
)
#: The rule model reads the visible columns.
RULES = ExpressionModel(
    {
        PRAISE: lambda text: text.rlike(r"\b(charming|moving|thrilling)\b"),
        SCORE: lambda *_: F.when(F.col("originalScore").rlike(r"^[0-9.]+/5$"), F.split_part("originalScore", F.lit("/"), F.lit(1))),
    },
    ModelSpec("rules"),
)

TOP = "(SELECT id FROM reviews WHERE id IS NOT NULL GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"
FIRST = "(SELECT min(id) FROM (SELECT id FROM reviews WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews")


def _of_top(reviews: DataFrame) -> DataFrame:
    """Reviews of the most reviewed movie."""
    top = reviews.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1)
    return reviews.filter(F.col("id") == top.select("id").scalar())


@query("SELECT DISTINCT reviewId FROM reviews WHERE scoreSentiment = 'POSITIVE' ORDER BY reviewId LIMIT 5")
def sem_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    """Five clearly positive reviews."""
    return sem.sem_filter(_reviews(spark, d), POSITIVE, GOLD).select("reviewId").distinct().orderBy("reviewId").limit(5)


@query(f"SELECT DISTINCT reviewId FROM reviews WHERE id = {TOP} AND scoreSentiment = 'POSITIVE' ORDER BY reviewId LIMIT 5")
def sem_filter_relational(spark: SparkSession, d: str) -> DataFrame:
    """Five clearly positive reviews of one movie."""
    return sem.sem_filter(_of_top(_reviews(spark, d)), POSITIVE, GOLD).select("reviewId").distinct().orderBy("reviewId").limit(5)


@query(f"SELECT count(*) AS positive_review_cnt FROM reviews WHERE id = {TOP} AND scoreSentiment = 'POSITIVE'")
def sem_filter_count(spark: SparkSession, d: str) -> DataFrame:
    """How many reviews of one movie are positive."""
    return sem.sem_filter(_of_top(_reviews(spark, d)), POSITIVE, GOLD).agg(F.count(F.lit(1)).alias("positive_review_cnt"))


@query("SELECT count(*) AS n FROM reviews WHERE coalesce(scoreSentiment = 'POSITIVE', TRUE)")
def sem_filter_default(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose answer can't be read count as true."""
    return sem.sem_filter(_reviews(spark, d), POSITIVE, GOLD, default=True).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round(sum(CASE WHEN scoreSentiment = 'POSITIVE' THEN 1 ELSE 0 END) / count(*), 9) AS positivity_ratio FROM reviews WHERE id = {TOP}")
def sem_case_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The share of positive reviews of one movie."""
    judged = sem.sem_if(_of_top(_reviews(spark, d)), POSITIVE, GOLD, "positive")
    return judged.agg(F.round(F.coalesce(F.avg(F.when(F.col("positive"), 1).otherwise(0)), F.lit(0.0)), 9).alias("positivity_ratio"))


def _pairs(spark: SparkSession, d: str, prompt: str) -> DataFrame:
    sizes = _reviews(spark, d).filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reviews = _reviews(spark, d).filter(F.col("id") == sizes.agg(F.min("id")).scalar()).select("id", "reviewId", "reviewText", "scoreSentiment")
    pairs = sem.sem_join(reviews, reviews, prompt, GOLD, on=[("id", "id")], unlike=("reviewId", "reviewId"))
    out = pairs.select(F.col("id_left").alias("id"), F.col("reviewId_left").alias("reviewId1"), F.col("reviewId_right").alias("reviewId2")).distinct()
    return out.orderBy("reviewId1", "reviewId2").limit(10)


_PAIRS = """SELECT DISTINCT a.id, a.reviewId AS reviewId1, b.reviewId AS reviewId2 FROM reviews a JOIN reviews b ON a.id = b.id AND a.reviewId <> b.reviewId
    WHERE a.id = {first} AND a.scoreSentiment {op} b.scoreSentiment ORDER BY reviewId1, reviewId2 LIMIT 10"""


@query(_PAIRS.format(first=FIRST, op="="))
def sem_join_self_same(spark: SparkSession, d: str) -> DataFrame:
    """Ten pairs of reviews of one movie with the same sentiment."""
    return _pairs(spark, d, SAME)


@query(_PAIRS.format(first=FIRST, op="<>"))
def sem_join_self_opposite(spark: SparkSession, d: str) -> DataFrame:
    """Ten pairs of reviews of one movie with opposite sentiments."""
    return _pairs(spark, d, OPPOSITE)


@query("""
    WITH r AS (SELECT DISTINCT id, reviewId, scoreSentiment FROM reviews WHERE id IS NOT NULL AND scoreSentiment IS NOT NULL),
    g AS (SELECT id, scoreSentiment, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT id, count(*) AS n FROM r GROUP BY ALL)
    SELECT r.id, r.reviewId, r.scoreSentiment AS class, t.n - g.n AS n_links FROM r JOIN g USING (id, scoreSentiment) JOIN t ON r.id = t.id""")
def sem_join_opposite_links(spark: SparkSession, d: str) -> DataFrame:
    """Every review of every movie with its class and how many reviews of the movie it is opposed to.

    The join's condition depends on the classes only, so its pairs are counted per pair of
    classes and not listed; a movie with most of the reviews makes no large task.
    """
    judged = sem.sem_classify(_reviews(spark, d), SENTIMENT, ["POSITIVE", "NEGATIVE"], GOLD, "class")
    rows = judged.filter(F.col("id").isNotNull() & F.col("class").isNotNull()).select("id", "reviewId", "class").distinct()
    by_class = rows.groupBy("id", "class").agg(F.count(F.lit(1)).alias("n"))
    total = by_class.groupBy("id").agg(F.sum("n").alias("all"))
    links = by_class.join(total, "id").select("id", "class", (F.col("all") - F.col("n")).alias("n_links"))
    return rows.join(links, ["id", "class"]).select("id", "reviewId", "class", "n_links")


@query("""
    WITH r AS (SELECT DISTINCT id, reviewId, scoreSentiment FROM reviews WHERE id IS NOT NULL AND scoreSentiment IN ('POSITIVE', 'NEGATIVE')),
    g AS (SELECT id, scoreSentiment, count(reviewId) AS n FROM r GROUP BY ALL)
    SELECT r.id, r.reviewId, r.scoreSentiment AS class, CASE WHEN r.reviewId IS NULL THEN 0 ELSE g.n - 1 END AS n_links FROM r JOIN g USING (id, scoreSentiment)""")
def sem_join_same_links(spark: SparkSession, d: str) -> DataFrame:
    """Every review of every movie with its class and how many other reviews of the movie share it.

    Counted per class of a movie, like the links of opposite classes; a review without an
    id is no other review than any, so it has no links.
    """
    judged = sem.sem_classify(_reviews(spark, d), SENTIMENT, ["POSITIVE", "NEGATIVE"], GOLD, "class")
    rows = judged.filter(F.col("id").isNotNull() & F.col("class").isNotNull()).select("id", "reviewId", "class").distinct()
    by_class = rows.groupBy("id", "class").agg(F.count("reviewId").alias("n"))
    links = F.when(F.col("reviewId").isNull(), F.lit(0).cast("long")).otherwise(F.col("n") - 1)
    return rows.join(by_class, ["id", "class"]).select("id", "reviewId", "class", links.alias("n_links"))


@query(f"""SELECT s.scoreSentiment, count(r.scoreSentiment) AS "count" FROM (VALUES ('POSITIVE'), ('NEGATIVE'), ('MIXED')) s(scoreSentiment)
    LEFT JOIN (SELECT * FROM reviews WHERE id = {TOP}) r ON r.scoreSentiment = s.scoreSentiment GROUP BY s.scoreSentiment""")
def value_counts_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of one movie per sentiment, with zero for a class that has none."""
    labels = ["POSITIVE", "NEGATIVE", "MIXED"]
    judged = sem.sem_classify(_of_top(_reviews(spark, d)), SENTIMENT, labels, GOLD, "label")
    counts = judged.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    wanted = spark.createDataFrame([(x,) for x in labels], "scoreSentiment string")
    return wanted.join(counts, F.col("scoreSentiment") == F.col("label"), "left").select("scoreSentiment", F.coalesce("count", F.lit(0)).alias("count"))


@query("SELECT scoreSentiment AS sentiment, count(*) AS n FROM reviews WHERE scoreSentiment IN ('POSITIVE', 'NEGATIVE') GROUP BY scoreSentiment")
def sem_classify_label(spark: SparkSession, d: str) -> DataFrame:
    """Reviews per class; answers outside the two classes are left out."""
    judged = sem.sem_classify(_reviews(spark, d), SENTIMENT, ["POSITIVE", "NEGATIVE"], GOLD, "sentiment")
    return judged.filter(F.col("sentiment").isNotNull()).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


_SCORED = """SELECT *, CASE WHEN s BETWEEN 1 AND 5 THEN s ELSE 3.0 END AS score FROM (SELECT *,
    CASE WHEN regexp_matches(originalScore, '^[0-9.]+/5$') THEN try_cast(split_part(originalScore, '/', 1) AS DOUBLE) END AS s FROM reviews)"""


@query(f"SELECT DISTINCT reviewId, score AS reviewScore FROM ({_SCORED}) WHERE id = {TOP}")
def sem_score_rubric(spark: SparkSession, d: str) -> DataFrame:
    """A score from 1 to 5 for each review of one movie; what can't be read is 3."""
    scored = sem.sem_score(_of_top(_reviews(spark, d)), SCORE, RULES, "reviewScore")
    return scored.select("reviewId", "reviewScore").distinct()


@query(f"SELECT id AS movieId, round(avg(score), 2) AS movieScore FROM ({_SCORED}) WHERE id IS NOT NULL GROUP BY id")
def sem_score_group_avg(spark: SparkSession, d: str) -> DataFrame:
    """The mean score of every movie."""
    scored = sem.sem_score(_reviews(spark, d).filter(F.col("id").isNotNull()), SCORE, RULES, "score")
    return scored.groupBy(F.col("id").alias("movieId")).agg(F.round(F.avg("score"), 2).alias("movieScore"))


@query(f"SELECT DISTINCT reviewId, score FROM ({_SCORED}) WHERE reviewId IS NOT NULL ORDER BY score DESC, reviewId LIMIT 20")
def sem_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty reviews of highest score."""
    scored = sem.sem_score(_reviews(spark, d).filter(F.col("reviewId").isNotNull()), SCORE, RULES, "score").select("reviewId", "score").distinct()
    return sem.sem_topk(scored, "score", 20, "reviewId")


@query(f"""SELECT id, reviewId, score FROM (SELECT DISTINCT id, reviewId, score FROM ({_SCORED}) WHERE id IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, reviewId) <= 1""")
def sem_topk_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The best review of each movie, by an aggregate of constant state instead of a sort per movie."""
    scored = sem.sem_score(_reviews(spark, d).filter(F.col("id").isNotNull()), SCORE, RULES, "score")
    best = scored.groupBy("id").agg(F.min_by(F.struct("reviewId", "score"), F.struct(-F.col("score"), F.col("reviewId"))).alias("b"))
    return best.select("id", "b.reviewId", "b.score")


@query(f"""WITH r AS (SELECT reviewId, max(score) AS score FROM ({_SCORED}) WHERE id = {TOP} GROUP BY reviewId),
    k AS (SELECT *, row_number() OVER (ORDER BY score DESC, reviewId) - 1 AS i, count(*) OVER () AS n FROM r)
    SELECT reviewId, CASE WHEN n = 1 THEN 3.0 ELSE round(5 - 4 * i / (n - 1), 1) END AS spread FROM k""")
def sem_rank_spread(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of one movie ranked and spread over 5 to 1."""
    scored = sem.sem_score(_of_top(_reviews(spark, d)), SCORE, RULES, "score").groupBy("reviewId").agg(F.max("score").alias("score"))
    return sem.rank_spread(scored, "score", "reviewId", "spread").select("reviewId", "spread")


@query(r"SELECT publicationName, count(*) AS n FROM reviews WHERE regexp_matches(reviewText, '\b(charming|moving|thrilling)\b') AND isTopCritic GROUP BY publicationName")
def sem_filter_rule(spark: SparkSession, d: str) -> DataFrame:
    """Praise by top critics per publication: the plain filter runs below the semantic one."""
    praised = sem.sem_filter(_reviews(spark, d), PRAISE, RULES).filter("isTopCritic")
    return praised.groupBy("publicationName").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT scoreSentiment, count(*) AS n FROM reviews WHERE reviewState = 'fresh' AND regexp_matches(reviewText, '\b(funny|brisk)\b') GROUP BY scoreSentiment")
def sem_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The same in SQL text with semantic functions, a template variable and a bound parameter."""
    _reviews(spark, d).createOrReplaceTempView("movie_reviews")
    statement = """SELECT scoreSentiment, count(*) AS n FROM <<source>> WHERE reviewState = :state
        AND AI_IF('the review finds the film amusing', reviewText) GROUP BY scoreSentiment"""
    return sem_sql(spark, statement, {"the review finds the film amusing": r"$1 RLIKE '\\b(funny|brisk)\\b'"}, {"source": "movie_reviews"}, state="fresh")


@query("""SELECT m.id, m.title, r.n FROM movies m JOIN (SELECT id, count(*) AS n FROM reviews WHERE scoreSentiment = 'POSITIVE' GROUP BY id) r ON m.id = r.id
    WHERE m.tomatoMeter >= 60""")
def sem_join_facts(spark: SparkSession, d: str) -> DataFrame:
    """Positive reviews of well-rated movies: reviews are counted per movie before the join."""
    positive = sem.sem_filter(_reviews(spark, d), POSITIVE, GOLD).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "movies").filter("tomatoMeter >= 60").join(positive, "id").select("id", "title", "n")


@query("""SELECT genre, string_agg(title, ', ' ORDER BY title) AS titles FROM (SELECT DISTINCT lower(trim(g)) AS genre, title
    FROM (SELECT title, unnest(string_split(genre, ',')) AS g FROM movies WHERE originalLanguage = 'French' AND title IS NOT NULL)) WHERE genre <> '' GROUP BY genre""")
def string_agg_by_group(spark: SparkSession, d: str) -> DataFrame:
    """French movies by genre: a generated array per movie, one row per item, titles joined per genre."""
    films = table(spark, d, "movies").filter((F.col("originalLanguage") == "French") & F.col("title").isNotNull())
    items = films.select("title", F.explode(F.split("genre", ",")).alias("g")).select(F.lower(F.trim("g")).alias("genre"), "title").distinct()
    return items.filter("genre <> ''").groupBy("genre").agg(F.array_join(F.sort_array(F.collect_list("title")), ", ").alias("titles"))


QUERIES, ORACLE = query.queries, query.oracle
