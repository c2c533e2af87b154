"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.language import mislabelled, segments, spans
from quern.llm.leakage import leaked
from quern.llm.packing import pack, summary
from quern.llm.pii import masked, personal_items
from quern.llm.truncation import source_rates, truncated
from quern.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose text lost its end."""
    return truncated(table(spark, d, "reviews"), "reviewId", "reviewText").select(F.col("row_id").alias("reviewId"))


def p1_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each publication cuts its reviews."""
    return source_rates(table(spark, d, "reviews"), "reviewId", "reviewText", "publicationName")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal items in complaints and symptom reports."""
    complaints = personal_items(table(spark, d, "complaints"), "complaint_id", "summary").withColumn("src", F.lit("complaints"))
    symptoms = personal_items(table(spark, d, "symptoms_texts"), "symptom_id", "symptoms").withColumn("src", F.lit("symptoms_texts"))
    return complaints.unionByName(symptoms).select("src", "rec_id", "pii_kind", "starts_at").distinct()


def p5_masked_complaints(spark: SparkSession, d: str) -> DataFrame:
    """Complaints with typed placeholders in place of personal items."""
    return masked(table(spark, d, "complaints").select("complaint_id", "summary"), "summary").drop("summary").distinct()


def p5_masked_symptoms(spark: SparkSession, d: str) -> DataFrame:
    """Symptom reports with typed placeholders in place of personal items."""
    return masked(table(spark, d, "symptoms_texts").select("symptom_id", "symptoms"), "symptoms").drop("symptoms").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document and its container of 2,048 tokens."""
    return pack(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, against the fewest possible."""
    return summary(p6_containers(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items whose passages they hold, whole or in part."""
    return leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: its task and the number of documents that hold it."""
    items = table(spark, d, "eval_items").select("item_id", "task")
    return p7_found(spark, d).groupBy("item_id").agg(F.count("doc_id").alias("n_docs")).join(items, "item_id").select("item_id", "task", "n_docs")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The segments of documents whose label is missing or wrong, or that mix languages."""
    return mislabelled(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document, with its language and a confidence."""
    found = segments(table(spark, d, "documents"), "doc_id", "text", "lang")
    return found.select("doc_id", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "n_words")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of words in one language of every document that has several, also inside sentences."""
    found = spans(table(spark, d, "documents"), "doc_id", "text", "lang")
    several = found.groupBy("doc_id").agg(F.max("span_no").alias("n_spans"), F.collect_list(F.struct("span_no", "lang", "first_word", "n_words")).alias("s"))
    return several.filter("n_spans > 1").select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")


QUERIES = {f.__name__: f for f in (p1_found, p1_source_rates, p5_found, p5_masked_complaints, p5_masked_symptoms, p6_containers, p6_summary, p7_found, p7_items, p8_found, p8_segments, p8_spans)}
ORACLE: dict[str, str] = {}
