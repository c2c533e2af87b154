"""Two modalities per place: sightings of one kind by picture and of another by sound.

The places are the nations of customers and suppliers; a segment or balance stands for
what a picture shows, as no pictures are among the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.models.base import ExpressionModel, ModelSpec
from quern.operators import semantic as sem
from quern.plans.plan import in_all, union_of
from quern.queries.registry import Book
from quern.tables import table

query = Book()

SEEN = "The picture shows the first animal: {c_name}"
SEEN_OTHER = "The picture shows the second animal: {c_name}"
HEARD = "The recording has the first animal: {s_name}"
HEARD_OTHER = "The recording has the second animal: {s_name}"
GOLD = ExpressionModel(
    {
        SEEN: lambda *_: F.col("c_mktsegment").like("%BUILD%"),
        SEEN_OTHER: lambda *_: F.col("c_mktsegment").like("%MACH%"),
        HEARD: lambda *_: F.col("s_acctbal") > 6000,
        HEARD_OTHER: lambda *_: F.col("s_acctbal") < 2000,
    },
    ModelSpec("gold"),
)


def _seen(spark: SparkSession, d: str, prompt: str) -> DataFrame:
    return sem.sem_filter(table(spark, d, "customer"), prompt, GOLD).select(F.col("c_nationkey").alias("city"), F.pmod("c_custkey", F.lit(4)).alias("station"))


def _heard(spark: SparkSession, d: str, prompt: str) -> DataFrame:
    return sem.sem_filter(table(spark, d, "supplier"), prompt, GOLD).select(F.col("s_nationkey").alias("city"))


_S1, _S2 = "(SELECT c_nationkey AS city FROM customer WHERE c_mktsegment LIKE '%BUILD%')", "(SELECT c_nationkey AS city FROM customer WHERE c_mktsegment LIKE '%MACH%')"
_H1, _H2 = "(SELECT s_nationkey AS city FROM supplier WHERE s_acctbal > 6000)", "(SELECT s_nationkey AS city FROM supplier WHERE s_acctbal < 2000)"


@query(f"SELECT city FROM (SELECT city, count(*) AS n FROM {_S1} GROUP BY city) QUALIFY rank() OVER (ORDER BY n DESC) = 1")
def ties_at_max(spark: SparkSession, d: str) -> DataFrame:
    """The places with most pictures of the animal, ties kept."""
    counts = _seen(spark, d, SEEN).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") == counts.agg(F.max("n")).scalar()).select("city")


@query(f"SELECT city, n FROM (SELECT city, count(*) AS n FROM {_H1} GROUP BY city) ORDER BY n DESC, city LIMIT 1")
def top1_by_count(spark: SparkSession, d: str) -> DataFrame:
    """One place with most recordings."""
    counts = _heard(spark, d, HEARD).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "city").limit(1)


@query(f"SELECT city FROM {_S1} UNION SELECT city FROM {_H1}")
def sem_union_modalities(spark: SparkSession, d: str) -> DataFrame:
    """Places where the animal was seen or heard."""
    return union_of("city", _seen(spark, d, SEEN), _heard(spark, d, HEARD))


@query(f"SELECT DISTINCT s.city FROM {_S1} s WHERE NOT EXISTS (SELECT 1 FROM {_H1} h WHERE h.city = s.city)")
def sem_anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """Places where the animal was seen but not heard."""
    return _seen(spark, d, SEEN).select("city").distinct().join(_heard(spark, d, HEARD), "city", "left_anti")


@query(f"SELECT city FROM {_S1} INTERSECT SELECT city FROM {_S2}")
def sem_intersect_places(spark: SparkSession, d: str) -> DataFrame:
    """Places with pictures of both animals."""
    return in_all("city", _seen(spark, d, SEEN), _seen(spark, d, SEEN_OTHER))


@query(f"(SELECT city FROM {_S1} UNION SELECT city FROM {_H1}) INTERSECT (SELECT city FROM {_S2} UNION SELECT city FROM {_H2})")
def sem_union_intersect_nested(spark: SparkSession, d: str) -> DataFrame:
    """Places where both animals were seen or heard."""
    first = union_of("city", _seen(spark, d, SEEN), _heard(spark, d, HEARD))
    second = union_of("city", _seen(spark, d, SEEN_OTHER), _heard(spark, d, HEARD_OTHER))
    return in_all("city", first, second)


@query("""SELECT city, station, n FROM (SELECT c_nationkey AS city, c_custkey % 4 AS station, count(*) AS n FROM customer WHERE c_mktsegment LIKE '%BUILD%' GROUP BY ALL)
    QUALIFY n = max(n) OVER (PARTITION BY city)""")
def max_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Per place the stations with most pictures, ties kept."""
    counts = _seen(spark, d, SEEN).groupBy("city", "station").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(F.col("city").alias("_c")).agg(F.max("n").alias("_n"))
    return counts.join(best, (F.col("city") == F.col("_c")) & (F.col("n") == F.col("_n"))).select("city", "station", "n")


QUERIES, ORACLE = query.queries, query.oracle
