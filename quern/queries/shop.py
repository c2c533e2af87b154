"""Products, pictures as vectors, and documents: typed extraction, cascades, nearest classes and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import grams, lookup, value_index
from quern.models.base import ExpressionModel, ModelSpec, cosine
from quern.operators import semantic as sem
from quern.queries.registry import Book
from quern.staging import stage
from quern.tables import table

query = Book()

BRAND = "Which brand is the product {p_name}?"
COLOUR = "Which colour does {p_name} have?"
SIZE = "How large is {p_name}, as a number?"
LIGHT = "The product {p_name} is small and cheap"
SAME_BRAND = "Both products have the same brand and colour: {p_name:left} / {p_name:right}"
MATCH = "A customer of {c_name} is served by a supplier of {s_name} from the same country"

RULES = ExpressionModel(
    {
        BRAND: lambda *_: F.col("p_brand"),
        COLOUR: lambda *_: F.split_part("p_name", F.lit(" "), F.lit(1)),
        SIZE: lambda *_: F.regexp_extract(F.col("p_size").cast("string"), r"(\d+)", 1),
        LIGHT: lambda *_: (F.col("p_size") <= 10) & (F.col("p_retailprice") < 1200),
    },
    ModelSpec("rules"),
)


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


@query("SELECT p_partkey, p_brand AS brand, split_part(p_name, ' ', 1) AS colour, try_cast(regexp_extract(CAST(p_size AS VARCHAR), '(\\d+)', 1) AS INTEGER) AS size FROM part")
def sem_extract_typed(spark: SparkSession, d: str) -> DataFrame:
    """Brand, colour and size of every product as typed columns."""
    fields = {"brand": (BRAND, "string"), "colour": (COLOUR, "string"), "size": (SIZE, "int")}
    return sem.sem_extract(_part(spark, d), fields, RULES).select("p_partkey", "brand", "colour", "size")


@query("SELECT p_partkey, '{\"id\":' || p_partkey || ',\"brand\":\"' || p_brand || '\",\"light\":' || (p_size <= 10 AND p_retailprice < 1200) || '}' AS product FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def json_object_compact(spark: SparkSession, d: str) -> DataFrame:
    """Products of two brands as JSON objects with a judged field."""
    judged = sem.sem_if(_part(spark, d).filter(F.col("p_brand").isin("Brand#1", "Brand#2")), LIGHT, RULES, "light")
    packed = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "light"))
    return judged.select("p_partkey", packed.alias("product"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def json_field_extract(spark: SparkSession, d: str) -> DataFrame:
    """A field of each purchase's properties."""
    events = table(spark, d, "events").filter("event_type = 'purchase'")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT o.n_name, count(*) AS n_suppliers FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN nation o ON o.n_nationkey = n.n_nationkey
    WHERE s.s_acctbal > 0 GROUP BY o.n_name""")
def sem_join_multiway(spark: SparkSession, d: str) -> DataFrame:
    """Three tables joined by keys that the prompts name, filters below the joins."""
    suppliers = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    model = ExpressionModel({"{s_name:left} is in {n_name:right}": F.lit(True), "{n_name:left} is {n_name:right}": F.col("n_name_left") == F.col("n_name_right")})
    first = sem.sem_join(suppliers, nations, "{s_name:left} is in {n_name:right}", model, on=[("s_nationkey", "n_nationkey")])
    second = sem.sem_join(first, nations, "{n_name:left} is {n_name:right}", model, on=[("n_nationkey", "n_nationkey")])
    return second.groupBy(F.col("n_name_right").alias("n_name")).agg(F.count(F.lit(1)).alias("n_suppliers"))


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_PROTO = "(SELECT label, list(CAST(m AS DOUBLE) ORDER BY i) AS proto FROM (SELECT label, i, avg(embedding[i]) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"


def _prototypes(vectors: DataFrame) -> DataFrame:
    """The mean vector of each class."""
    places = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("proto"))


@query(f"SELECT vec_id, min_by(label, (-round(s, 9), label)) AS nearest FROM (SELECT v.vec_id, p.label, {_COS.format(a='v.embedding', b='p.proto')} AS s FROM embeddings v, {_PROTO} p) GROUP BY vec_id")
def sem_classify_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's class by the nearest class mean."""
    vectors = table(spark, d, "embeddings")
    return sem.classify_nearest(vectors.select("vec_id", "embedding"), "vec_id", "embedding", _prototypes(vectors), "label", "proto", "nearest").select("vec_id", "nearest")


@query(f"""WITH q AS (SELECT proto FROM {_PROTO} WHERE label = 3) SELECT vec_id, round({_COS.format(a='embedding', b='proto')}, 6) AS similarity FROM embeddings, q
    ORDER BY round({_COS.format(a='embedding', b='proto')}, 9) DESC, vec_id LIMIT 20""")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty vectors nearest to a class mean."""
    vectors = table(spark, d, "embeddings")
    mean = _prototypes(vectors.filter("label = 3")).select("proto").first()
    top = sem.retrieve(vectors, "vec_id", "embedding", mean["proto"] if mean else [0.0] * 64, 20)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT proto FROM {_PROTO} WHERE label = 3) SELECT vec_id FROM (SELECT vec_id, label FROM embeddings, q
    ORDER BY round({_COS.format(a='embedding', b='proto')}, 9) DESC, vec_id LIMIT 100) WHERE label = 3""")
def sem_retrieve_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Of the hundred nearest vectors those that a second model confirms."""
    vectors = table(spark, d, "embeddings")
    mean = _prototypes(vectors.filter("label = 3")).select("proto").first()
    confirm = (F.col("label") == 3).cast("double")
    return sem.retrieve(vectors, "vec_id", "embedding", mean["proto"] if mean else [0.0] * 64, 100, confirm, 1.0).select("vec_id")


_ALL = f"""SELECT q.vec_id AS query_id, q.label AS asked, v.vec_id, v.label, {_COS.format(a='q.embedding', b='v.embedding')} AS s
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"""
_NEAR = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)"


@query(f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM ({_ALL}) {_NEAR} <= 20")
def embedding_topk_queries(spark: SparkSession, d: str) -> DataFrame:
    """The twenty vectors nearest to each vector whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings")
    top = sem.retrieve_many(vectors, "vec_id", "embedding", vectors.filter("vec_id % 100 = 0"), 20)
    return top.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT query_id, vec_id FROM (SELECT * FROM ({_ALL}) {_NEAR} <= 100) WHERE label = asked")
def sem_retrieve_rerank_queries(spark: SparkSession, d: str) -> DataFrame:
    """Of the hundred vectors nearest to each query those that a second model confirms: of the query's class."""
    vectors = table(spark, d, "embeddings")
    labels = vectors.select("vec_id", "label")
    top = sem.retrieve_many(vectors, "vec_id", "embedding", vectors.filter("vec_id % 100 = 0"), 100).join(labels, "vec_id")
    asked = labels.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    return top.join(asked, "query_id").filter(F.col("label") == F.col("asked")).select("query_id", "vec_id")


@query(f"""SELECT decided_by, count(*) AS n FROM (SELECT CASE WHEN s >= 0.6 THEN 'proxy' ELSE 'oracle' END AS decided_by FROM (SELECT v.label AS a, p.label AS b,
    {_COS.format(a='v.embedding', b='p.proto')} AS s FROM embeddings v, {_PROTO} p) WHERE s >= 0.6 OR (s >= 0.1 AND a = b)) GROUP BY decided_by""")
def sem_join_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Vectors matched with class means: accepted by the proxy, or by the oracle where it is undecided."""
    vectors = table(spark, d, "embeddings")
    pairs = vectors.join(F.broadcast(_prototypes(vectors).select(F.col("label").alias("class"), "proto")), F.col("proto").isNotNull())
    matched = sem.join_cascade(pairs, cosine(F.col("embedding"), F.col("proto")), 0.6, 0.1, F.col("label") == F.col("class"))
    return matched.groupBy("decided_by").agg(F.count(F.lit(1)).alias("n"))


#: The labelled sample of a cascade: so many vectors, by a seeded hash of their id, each with every class.
SAMPLE_ROWS, SAMPLE_SEED = 1000, 42
RECALL, PRECISION = 0.8, 0.8


def cascade_to_targets(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, class, decided_by) of the pairs of vectors and class means that the cascade keeps.

    The thresholds come from the labelled sample. As a sample's recall is off by chance, its
    target is raised by the one-sided 95 % bound of that; with no true pair in the sample
    the oracle is asked of all pairs. The class means, a closed set, go along as one array.
    """
    classes = _prototypes(vectors).select(F.col("label").alias("class"), "proto")
    means = stage(classes.agg(F.collect_list(F.struct("class", "proto")).alias("means")), "means")
    pair = lambda rows: rows.withColumn("_m", F.explode(means.scalar())).select("vec_id", "label", "embedding", "_m.class", "_m.proto")
    similarity, truth = cosine(F.col("embedding"), F.col("proto")), F.col("label") == F.col("class")
    some = vectors.orderBy(F.xxhash64("vec_id", F.lit(SAMPLE_SEED)), "vec_id").limit(SAMPLE_ROWS)
    sample = stage(pair(some).select(similarity.alias("s"), F.coalesce(truth, F.lit(False)).alias("truth")), "sample")
    n_true = sample.filter("truth AND s IS NOT NULL").count()
    accept, reject = float("inf"), -1.0
    if n_true:
        target = min(1.0, RECALL + 1.645 * (RECALL * (1 - RECALL) / n_true) ** 0.5)
        accept, reject = sem.cascade_thresholds(sample, "s", "truth", target, PRECISION)
    return sem.join_cascade(pair(vectors), similarity, accept, reject, truth).select("vec_id", "label", "class", "decided_by")


@query()
def sem_join_cascade_targets(spark: SparkSession, d: str) -> DataFrame:
    """Vectors matched with class means by a cascade whose thresholds meet a recall and a precision of 0.8."""
    matched = cascade_to_targets(table(spark, d, "embeddings").select("vec_id", "label", "embedding"))
    return matched.groupBy("decided_by").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c.c_custkey, max_by(o.o_orderkey, (o.o_totalprice, -o.o_orderkey)) AS best FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
    WHERE c.c_mktsegment = 'BUILDING' GROUP BY c.c_custkey""")
def sem_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Per customer of a segment the best match among the orders."""
    pairs = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return sem.best_match(pairs, "c_custkey", "o_orderkey", "o_totalprice", "best")


@query("""WITH k AS (SELECT count(DISTINCT p_brand) AS n FROM part WHERE p_brand IS NOT NULL) SELECT p_type AS common FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL
    GROUP BY p_type HAVING count(DISTINCT p_brand) = (SELECT n FROM k)""")
def sem_agg_intersection(spark: SparkSession, d: str) -> DataFrame:
    """The types that every brand makes."""
    return sem.sem_agg(_part(spark, d), "p_type", "p_brand", "common")


@query("SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY item")
def sem_generate_array_explode(spark: SparkSession, d: str) -> DataFrame:
    """A generated array per product, one row per element."""
    model = ExpressionModel({"List the words of {p_name}": lambda c: F.to_json(F.split(c, " "))})
    listed = sem.sem_map(_part(spark, d), "List the words of {p_name}", model, "words")
    return listed.select(F.explode(F.from_json("words", "array<string>")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT title FROM movies WHERE list_has_all(list_transform(string_split(genre, ','), lambda x: trim(x)), ['Drama', 'Comedy']) AND title IS NOT NULL""")
def list_has_all(spark: SparkSession, d: str) -> DataFrame:
    """Movies whose list of genres has both of two."""
    genres = F.transform(F.split("genre", ","), lambda x: F.trim(x))
    wanted = F.array(F.lit("Drama"), F.lit("Comedy"))
    return table(spark, d, "movies").filter((F.size(F.array_except(wanted, genres)) == 0) & F.col("title").isNotNull()).select("title")


@query("SELECT reviewId, try_cast(split_part(originalScore, '/', 1) AS DOUBLE) AS score FROM reviews WHERE originalScore LIKE '%/5'")
def split_part_cast(spark: SparkSession, d: str) -> DataFrame:
    """The number before the stroke of a score."""
    reviews = table(spark, d, "reviews").filter(F.col("originalScore").like("%/5"))
    return reviews.select("reviewId", F.split_part("originalScore", F.lit("/"), F.lit(1)).try_cast("double").alias("score"))


@query("""WITH v AS (SELECT DISTINCT director AS value FROM movies WHERE director IS NOT NULL), w AS (SELECT DISTINCT criticName AS asked FROM reviews WHERE criticName IS NOT NULL),
    g AS (SELECT DISTINCT value, substr('####' || lower(value) || '####', i, 5) AS gram FROM v, range(1, 200) r(i) WHERE i <= length(value) + 4),
    h AS (SELECT DISTINCT asked, substr('####' || lower(asked) || '####', i, 5) AS gram FROM w, range(1, 200) r(i) WHERE i <= length(asked) + 4),
    s AS (SELECT asked, value, count(*) AS shared FROM h JOIN g USING (gram) GROUP BY ALL)
    SELECT asked, value, shared FROM s QUALIFY row_number() OVER (PARTITION BY asked ORDER BY shared DESC, value) = 1""")
def ngram_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each critic the director whose name is most alike, by shared runs of letters."""
    index = value_index(table(spark, d, "movies"), "director")
    critics = table(spark, d, "reviews").filter("criticName IS NOT NULL").select(F.col("criticName").alias("asked"))
    return lookup(index, critics, "asked", 1).select("asked", "value", "shared")


@query("SELECT gram, count(*) AS n FROM (SELECT DISTINCT p_type, substr('####' || lower(p_type) || '####', i, 5) AS gram FROM part, range(1, 200) r(i) WHERE i <= length(p_type) + 4) GROUP BY gram")
def ngram_index(spark: SparkSession, d: str) -> DataFrame:
    """How many product types hold each run of five letters."""
    types = _part(spark, d).select("p_type").distinct()
    return types.select(F.explode(grams(F.col("p_type"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = query.queries, query.oracle
