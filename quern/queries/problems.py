"""Queries of the general data problems: units (2), heavy keys (3), packed fields (4)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.measures import score_milli, source_scales, text_quantities
from quern.operators.packed import split_packed
from quern.operators.skew import compress, heavy_keys, value_stats, weighted_percentiles
from quern.tables import table


def _scored(spark: SparkSession, d: str, *more: str) -> DataFrame:
    reviews = table(spark, d, "reviews").select("reviewId", "publicationName", "originalScore", "reviewText", *more)
    return score_milli(reviews, "originalScore", "reviewText", "publicationName", table(spark, d, "grade_scale"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose score has a value and a scale, in thousandths of the full scale."""
    return _scored(spark, d).filter(F.col("score_milli").isNotNull() & F.col("reviewId").isNotNull()).select("reviewId", "score_milli").distinct()


def p2_source_scales(spark: SparkSession, d: str) -> DataFrame:
    """The scale each publication mostly uses."""
    return source_scales(table(spark, d, "reviews"), "originalScore", "publicationName")


def p2_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Speeds named in complaints, in metres a second."""
    found = text_quantities(table(spark, d, "complaints").select("complaint_id", "summary"), "summary")
    speed = F.array(*[F.lit(x) for x in (1, 0, -1, 0, 0, 0, 0, 0, 0)])
    return found.filter(F.col("dims") == speed).select("complaint_id", F.round("value", 4).alias("metres_a_second")).distinct()


def p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Pressures, and lengths of a thousand miles or more, named in complaints, in coherent units."""
    found = text_quantities(table(spark, d, "complaints").select("complaint_id", "summary"), "summary")
    of = {"pressure": (-1, 1, -2), "length": (1, 0, 0)}
    unit = F.coalesce(*[F.when(F.col("dims") == F.array(*[F.lit(x) for x in (*v, *[0] * (9 - len(v)))]), F.lit(k)) for k, v in of.items()])
    named = found.withColumn("unit", unit).filter("unit IS NOT NULL AND (unit <> 'length' OR value >= 1609344)")
    return named.select("complaint_id", "unit", F.round("value", 2).alias("canonical")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Movie ids that hold at least 2 % of all reviews."""
    reviews = table(spark, d, "reviews").select("id", "originalScore")
    return heavy_keys(reviews, "id", "originalScore", Fraction(1, 50)).select("id")


def p3_movies(spark: SparkSession, d: str) -> DataFrame:
    """Per movie: rows, distinct notations, the commonest one and the latest review."""
    reviews = table(spark, d, "reviews").filter(F.col("id").isNotNull())
    stats = value_stats(reviews.select("id", "originalScore"), "id", "originalScore")
    newest = F.max(F.struct("loaded_at", "reviewId"))
    packed = compress(reviews.filter(F.col("loaded_at").isNotNull()), "id", ["originalScore"], newest=newest)
    latest = packed.groupBy("id").agg(F.max("newest").alias("newest"))
    return stats.join(latest, "id", "left").select("id", "n_rows", "n_values", "n_distinct", "mode", F.col("newest.reviewId").alias("latest_review"))


def p3_mean_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per movie: rows, scored rows, mean score in thousandths, and whether it is a heavy key."""
    scored = _scored(spark, d, "id").filter(F.col("id").isNotNull())
    weight = F.col("_weight")
    mean = F.sum(F.col("score_milli") * weight) / F.sum(F.when(F.col("score_milli").isNotNull(), weight))
    per_id = compress(scored, "id", ["score_milli"]).groupBy("id").agg(
        F.sum(weight).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("score_milli").isNotNull(), weight)), F.lit(0).cast("long")).alias("n_scored"),
        F.round(mean, 3).alias("mean_milli"),
    )
    total = table(spark, d, "reviews").agg(F.count(F.lit(1))).scalar()
    return per_id.withColumn("heavy", F.col("n_rows") * 50 >= total)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per movie: exact quartiles of the length of its reviews."""
    lengths = table(spark, d, "reviews").select("id", F.char_length("reviewText").cast("long").alias("n_chars"))
    return weighted_percentiles(lengths, "id", "n_chars", [0.25, 0.5, 0.75])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The damages of every image that has two or more."""
    images = table(spark, d, "car_images").select("image_id", "damage_status")
    split = split_packed(images, "damage_status", 2).filter(F.col("image_id").isNotNull())
    return split.select("image_id", "pos", F.col("value").alias("damage")).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_source_scales, p2_speeds, p2_quantities, p3_found, p3_movies, p3_mean_scores, p3_percentiles, p4_found)}

ORACLE = {
    "p2_speeds": """
        SELECT DISTINCT complaint_id, round(CAST(x AS DOUBLE) * f, 4) AS metres_a_second
        FROM (SELECT complaint_id, f, unnest(regexp_extract_all(summary, '(?i)\\b(\\d+)' || unit || '\\b', 1)) AS x FROM complaints,
            (VALUES ('\\s*(?:miles (?:per|an) hour|mph)', 0.44704), ('\\s*(?:km/h|kph|kmh|kilomet(?:re|er)s (?:per|an) hour)', 1 / 3.6), ('\\s*(?:m/s|met(?:re|er)s per second)', 1.0)) u(unit, f))""",
    "p2_quantities": """
        SELECT DISTINCT complaint_id, unit, round(CAST(replace(x, ',', '') AS DOUBLE) * f, 2) AS canonical
        FROM (SELECT complaint_id, unit, f, unnest(regexp_extract_all(summary, '(?i)\\b(\\d+(?:,\\d{3})*)\\s*' || word || '\\b', 1)) AS x FROM complaints,
            (VALUES ('pressure', 'psi', 6894.757293168362), ('length', 'thousand miles', 1609344.0), ('length', 'miles', 1609.344)) u(unit, word, f))
        WHERE unit <> 'length' OR CAST(replace(x, ',', '') AS DOUBLE) * f >= 1609344""",
    "p3_found": """
        SELECT id FROM reviews WHERE id IS NOT NULL GROUP BY id
        HAVING count(*) * 50 >= (SELECT count(*) FROM reviews)""",
    "p3_movies": """
        WITH r AS (SELECT * FROM reviews WHERE id IS NOT NULL),
        v AS (SELECT id, originalScore, count(*) AS n FROM r WHERE originalScore IS NOT NULL GROUP BY ALL),
        m AS (SELECT id, originalScore AS mode FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, originalScore) = 1),
        l AS (SELECT id, reviewId AS latest_review FROM r WHERE loaded_at IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, reviewId DESC) = 1)
        SELECT a.id, a.n_rows, a.n_values, a.n_distinct, m.mode, l.latest_review
        FROM (SELECT id, count(*) AS n_rows, count(originalScore) AS n_values, count(DISTINCT originalScore) AS n_distinct FROM r GROUP BY id) a
        LEFT JOIN m USING (id) LEFT JOIN l USING (id)""",
    "p3_percentiles": """
        WITH r AS (SELECT id, length(reviewText) AS n FROM reviews WHERE id IS NOT NULL AND reviewText IS NOT NULL),
        q AS (SELECT id, quantile_disc(n, [0.25, 0.5, 0.75]) AS v FROM r GROUP BY id)
        SELECT id, CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS share, unnest(v) AS n_chars FROM q""",
}
