"""Sources and sinks as round trips through the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.queries.registry import Book
from quern.sources import readers, writers
from quern.staging import existing, shared_folder
from quern.tables import table

query = Book()


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_csv(spark: SparkSession, d: str) -> DataFrame:
    """A result written as CSV and read by a schema."""
    path = _path(spark)
    writers.write_result(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return readers.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT n_nationkey, n_name FROM nation")
def source_csv_errors_skipped(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file of which the rows that don't fit are passed over."""
    path = _path(spark)
    good = table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    bad = good.filter("value LIKE '%1%'").select(F.concat(F.lit("x"), F.col("value")).alias("value"))
    spark.createDataFrame([("n_nationkey,n_name",)], "value string").unionByName(good).unionByName(bad).coalesce(1).write.text(path)
    return readers.read_csv(spark, path, "n_nationkey int, n_name string", skip_errors=True)


@query("SELECT r_regionkey, r_name FROM region")
def source_json_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder of JSON files with an object each, whose nested fields are lifted."""
    path = _path(spark)
    packed = table(spark, d, "region").select(F.struct("r_regionkey", "r_name").alias("item"), F.col("r_regionkey").alias("file"))
    packed.write.partitionBy("file").json(path)
    return readers.read_json_folder(spark, f"{path}/*", unnest="item", schema="item struct<r_regionkey: int, r_name: string>")


@query("SELECT n_name AS text, length(n_name) AS n FROM nation")
def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text per file."""
    path = _path(spark)
    table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("file")).write.partitionBy("file").text(path)
    texts = readers.read_texts(spark, f"{path}/*").select(F.trim(F.regexp_replace("text", r"\n", "")).alias("text"))
    return texts.select("text", F.char_length("text").cast("long").alias("n"))


@query("SELECT range AS k, range * range AS square FROM range(1000)")
def source_iterator(spark: SparkSession, d: str) -> DataFrame:
    """A user-defined source with random access."""
    readers.register_iterator(spark, "quern_squares", "k long, square long", 1000, lambda k: (k, k * k))
    return spark.read.format("quern_squares").load()


@query("SELECT n.n_name, CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name END AS held FROM nation n")
def source_files_joined(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the file that their path names; those without one keep nulls."""
    path = _path(spark)
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("file")).write.partitionBy("file").text(path)
    files = readers.read_files(spark, f"{path}/*", "*.txt")
    key = F.regexp_extract("path", r"file=(\d+)", 1)
    held = files.select("n_bytes", "content", F.concat(key, F.lit(".txt")).alias("filename"))
    rows = nation.withColumn("file_path", F.concat(F.lit("folder/"), F.col("n_nationkey").cast("string"), F.lit(".txt")))
    return readers.with_files(rows, "file_path", held).select("n_name", F.regexp_replace(F.decode("content", "UTF-8"), r"\n", "").alias("held"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus")
def sink_parquet_folders(spark: SparkSession, d: str) -> DataFrame:
    """A table in folders by a column, read back and counted."""
    path = _path(spark)
    writers.write_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT c_mktsegment AS query, CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE count(*) END AS value FROM customer GROUP BY c_mktsegment")
def sink_metrics_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Metrics put into a table twice: rows of the same keys are replaced, others stay."""
    path = _path(spark)
    first = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("query")).agg(F.count(F.lit(1)).alias("value"))
    writers.merge_metrics(first, path, ["query"])
    writers.merge_metrics(first.filter("query = 'BUILDING'").withColumn("value", F.lit(-1).cast("long")), path, ["query"])
    return spark.read.parquet(path)


@query("SELECT r_name AS query, r_regionkey AS value FROM region")
def sink_metrics_json(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as JSON lines."""
    path = _path(spark)
    writers.write_json(table(spark, d, "region").select(F.col("r_name").alias("query"), F.col("r_regionkey").alias("value")), path)
    return spark.read.schema("query string, value int").json(path)


@query("SELECT true AS first, false AS again, true AS changed, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)")
def sink_load_if_changed(spark: SparkSession, d: str) -> DataFrame:
    """A table is written when it is new or has other rows, and left alone when it has the same."""
    path, nation = _path(spark), table(spark, d, "nation")
    did = [writers.load_if_changed(spark, df, path) for df in (nation, nation, nation.unionByName(nation))]
    return existing(spark, path).agg(*[F.lit(x).alias(k) for k, x in zip(("first", "again", "changed"), did)], F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = query.queries, query.oracle
