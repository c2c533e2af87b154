"""Streams: incremental ingest by key, semantic filters over a stream, windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.semantic import new_only
from quern.staging import existing


def ingest_new(stream: DataFrame, key: str, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append ``work`` of the rows whose key isn't in the table at ``path`` yet; ended when the input is read.

    A batch that runs again after a failure finds its keys there and adds nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        known = existing(df.sparkSession, path)
        known = df.limit(0) if known is None else known
        work(new_only(known.select(key), df, key)).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def unit_vector(vector: Column) -> Column:
    """An ARRAY of numbers at length 1, as ARRAY<DOUBLE>; null where it has no length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def ingest_embeddings(stream: DataFrame, key: str, vector: str, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """As ``ingest_new``: ``embed`` adds ``vector`` to the rows of new keys only, and it is kept at length 1.

    Rows whose vector has no length aren't kept, so they are asked again when they come again.
    """
    return ingest_new(stream, key, path, checkpoint, lambda df: embed(df).withColumn(vector, unit_vector(F.col(vector))).filter(F.col(vector).isNotNull()))


def windowed_counts(events: DataFrame, time: str, by: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; rows later than ``late`` behind the newest are dropped in a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Rows per session: a key's events with no gap of ``gap`` or more between them."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), by, "n")
