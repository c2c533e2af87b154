"""Sinks: results, metrics that are merged by key, and tables written only when they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.staging import existing, stage


def write_result(df: DataFrame, path: str, single: bool = False) -> None:
    """A query's result as CSV with a header; ``single`` writes one file, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table as Parquet, in folders by ``by`` if given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A table of metrics as JSON, one object a line."""
    df.write.mode("overwrite").json(path)


def merge_metrics(new: DataFrame, path: str, keys: list[str]) -> None:
    """Put rows into a metrics table: rows of the same keys are replaced, others stay.

    Of several new rows of one key any is kept. The merged table is staged before the old
    one is overwritten, so a lost executor can't leave half of it.
    """
    spark = new.sparkSession
    new = new.dropDuplicates(keys)
    old = existing(spark, path)
    if old is None:
        new.write.mode("overwrite").parquet(path)
        return
    stage(old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True), "metrics").write.mode("overwrite").parquet(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, checksum) of a table, whatever the order of its rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return row["n"], hash((row["x"], row["s"]))


def load_if_changed(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Write a table unless the one at ``path`` has the same columns and rows; whether it was written."""
    old = existing(spark, path)
    if old is not None and sorted(old.columns) == sorted(df.columns) and fingerprint(old.select(df.columns)) == fingerprint(df):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
