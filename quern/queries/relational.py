"""The relational operators around the semantic ones, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog, describe, visible
from quern.models.base import ExpressionModel, ModelRegistry, ModelSpec
from quern.operators import semantic as sem
from quern.plans.plan import Filter, Rel, Scan, SemFilter, optimise, run
from quern.plans.steps import execute
from quern.queries.registry import Book
from quern.streaming.ingest import sessions, windowed_counts
from quern.tables import table

query = Book()


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 GROUP BY o_orderpriority")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority, with those that are done."""
    orders = table(spark, d, "orders").filter(F.col("o_totalprice").between(1000, 200000))
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def lineitem_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums and means of all lines by flag and status."""
    lines = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query("""SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
    JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    WHERE r.r_name = 'ASIA' GROUP BY n.n_name""")
def join_star(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation of one region: five tables, small ones broadcast by their size."""
    t = lambda name: table(spark, d, name)
    nations = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "n_name")
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def join_left_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order."""
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def join_left_semi(spark: SparkSession, d: str) -> DataFrame:
    """Brands of products that were bought in large numbers."""
    large = table(spark, d, "lineitem").filter("l_quantity >= 49")
    return table(spark, d, "part").join(large, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_brand").distinct()


@query("""SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Nations with suppliers but without very rich customers."""
    rich = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).subtract(rich)


@query("""SELECT p_brand, p_type, grouping_id(p_brand, p_type) AS level, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)""")
def group_cube(spark: SparkSession, d: str) -> DataFrame:
    """Products by brand, type, both and in all."""
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment || '-' || c_nationkey || '-' || c_custkey AS id FROM customer WHERE length(c_name) >= 10""")
def concat_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of several parts; a null part makes the id null."""
    parts = [F.col("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_custkey").cast("string")]
    return table(spark, d, "customer").filter(F.char_length("c_name") >= 10).select(F.concat(*parts).alias("id"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS starts, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour").select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 21600, TRUE) AS new FROM events),
    s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, count(DISTINCT k) AS n_sessions FROM s GROUP BY user_id""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per user with gaps of six hours."""
    return sessions(table(spark, d, "events"), "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"))


@query("SELECT n.n_name, count(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name")
def join_path_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Orders by nation over the chain of links that the catalogue finds."""
    c = Catalog()
    for name in ("orders", "customer", "nation"):
        c.add(name, table(spark, d, name))
    c.link("orders", "o_custkey", "customer", "c_custkey")
    c.link("customer", "c_nationkey", "nation", "n_nationkey")
    return c.joined("orders", "nation").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_retailprice < 1200 AND p_size <= 10 GROUP BY p_brand")
def plan_steps(spark: SparkSession, d: str) -> DataFrame:
    """A plan of JSON steps over registered tools."""
    catalog, registry = Catalog(), ModelRegistry()
    catalog.add("part", table(spark, d, "part"))
    registry.create_model("rules", ExpressionModel({"the product {p_name} is small": F.col("p_size") <= 10}, ModelSpec("rules")))
    steps = """[{"tool": "filter", "inputs": ["part"], "output": "cheap", "arguments": {"condition": "p_retailprice < 1200"}},
        {"tool": "sem_filter", "inputs": ["cheap"], "output": "small", "arguments": {"prompt": "the product {p_name} is small", "model": "rules"}},
        {"tool": "verify", "inputs": ["small"], "output": "small"},
        {"tool": "sql", "inputs": [], "output": "answer", "arguments": {"query": "SELECT p_brand, count(*) AS n FROM small GROUP BY p_brand"}}]"""
    return execute(steps, catalog, registry)


@query("""WITH a AS (SELECT * FROM documents WHERE kind = 'car' AND text LIKE '%brake%') SELECT x.source, x.n, y.n AS n_short FROM (SELECT source, count(*) AS n FROM a GROUP BY 1) x
    JOIN (SELECT source, count(*) AS n FROM a WHERE n_chars < 500 GROUP BY 1) y ON x.source = y.source""")
def plan_shared_filter(spark: SparkSession, d: str) -> DataFrame:
    """A semantic sub-result that two branches use: filters are ordered by cost and it is worked out once."""
    model = ExpressionModel({"the text {text} is about brakes": lambda c: c.like("%brake%")})
    docs = SemFilter([Scan(df=table(spark, d, "documents"))], "the text {text} is about brakes", model, price=9.0)
    shared = optimise(Filter([docs], F.col("kind") == "car"))
    all_of = Rel([shared], step=lambda x: x.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    short = Rel([shared], step=lambda x: x.filter("n_chars < 500").groupBy("source").agg(F.count(F.lit(1)).alias("n_short")))
    return run(Rel([all_of, short], step=lambda a, b: a.join(b, "source").select("source", "n", "n_short")))


@query("SELECT car_id, year, country FROM cars WHERE year = (SELECT max(year) FROM cars)")
def visible_columns(spark: SparkSession, d: str) -> DataFrame:
    """The newest cars without the columns that are hidden from models."""
    cars = describe(table(spark, d, "cars"), hidden=["vin", "number_plate", "mileage", "fuel_type", "transmission", "registration_date", "previous_owners"])
    seen = visible(cars)
    return seen.filter(F.col("year") == seen.agg(F.max("year")).scalar()).select("car_id", "year", "country")


@query("SELECT kind, lang, count(*) AS n, round(avg(n_chars), 3) AS mean_chars FROM documents WHERE lang IS NOT NULL AND n_chars >= 100 GROUP BY ALL")
def document_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents by kind and label."""
    docs = table(spark, d, "documents").filter("lang IS NOT NULL AND n_chars >= 100")
    return docs.groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))


@query("SELECT complaint_id, summary, 'brakes' AS answer FROM (SELECT DISTINCT complaint_id, summary FROM complaints WHERE lower(summary) LIKE '%brakes%')")
def text_qa_template(spark: SparkSession, d: str) -> DataFrame:
    """A question per row, asked once for equal rows."""
    rows = table(spark, d, "complaints").select("complaint_id", "summary").distinct()
    model = ExpressionModel({"Which part fails in {summary}?": lambda c: F.when(F.lower(c).like("%brakes%"), "brakes")})
    return sem.answer_templates(rows, "Which part fails in <summary>?", model, "answer").filter("answer IS NOT NULL")


QUERIES, ORACLE = query.queries, query.oracle
