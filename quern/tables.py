"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``: one file, or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a narrow scan one partition per core before a Python stage.

    A table in one small file is read as one partition, which would leave all cores but
    one idle. A scan that has enough partitions, as every large one has, stays as it is,
    so the rows of large tables aren't shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column has it; letter case doesn't tell columns apart."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
