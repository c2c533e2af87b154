"""Sources: tables in files, folders of texts, images and sounds, and user-defined iterators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", quote: str = '"', skip_errors: bool = False) -> DataFrame:
    """A CSV file with a header; without a schema the types are inferred. ``skip_errors`` drops rows that don't fit."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", quote).option("escape", quote).option("multiLine", True)
    reader = reader.option("mode", "DROPMALFORMED" if skip_errors else "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json_folder(spark: SparkSession, path: str, unnest: str | None = None, schema: str | None = None) -> DataFrame:
    """A folder of JSON files, one object each; columns are matched by name, and ``unnest`` lifts a struct's fields."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(f"{unnest}.*") if unnest else df


def read_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, filename, n_bytes, modified, content) of the files that match."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.substring_index("path", "/", -1)
    return df.select("path", name.alias("filename"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), "content")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """The images in a folder."""
    return read_files(spark, folder, "*.{png,jpg,jpeg}")


def read_sounds(spark: SparkSession, folder: str) -> DataFrame:
    """The sounds in a folder."""
    return read_files(spark, folder, "*.{wav,mp3,flac}")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, text): one row per text file."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return df.select(F.substring_index(F.input_file_name(), "/", -1).alias("filename"), F.col("value").alias("text"))


def with_files(df: DataFrame, path_column: str, files: DataFrame) -> DataFrame:
    """Rows with the file that their path names; rows without a file keep nulls."""
    name = F.substring_index(F.col(path_column), "/", -1)
    return df.join(files.select(F.col("filename").alias("_name"), "n_bytes", "content"), name == F.col("_name"), "left").drop("_name")


def register_iterator(spark: SparkSession, name: str, schema: str, length: int, item: Callable[[int], tuple], partitions: int = 4) -> None:
    """A user-defined source with random access, read as ``spark.read.format(name).load()``.

    ``item`` gives the row of a place from 0 to ``length`` - 1; it runs on the executors.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            step = max(1, -(-length // partitions))
            return [InputPartition((k, min(k + step, length))) for k in range(0, length, step)] or [InputPartition((0, 0))]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for k in range(*partition.value):
                yield item(k)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    spark.dataSource.register(Source)
