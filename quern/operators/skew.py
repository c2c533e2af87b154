"""Per-key results over keys of very unequal weight.

Value-frequency compression: rows are grouped by key *and value* first, with a count.
The partial aggregation on the map side shrinks a key that holds a third of all rows to
one row per distinct value and task, and its pairs spread over all reducers. Counts,
exact distinct counts, modes, means and percentiles then come from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.staging import stage

WEIGHT = "_weight"


def compress(df: DataFrame, key: str, values: Sequence[str | Column], **extra: Column) -> DataFrame:
    """One row per distinct (key, values...) with its number of rows in ``_weight``.

    ``extra`` are further aggregates of constant state, such as ``max``. Null keys and
    null values are groups of their own. An empty table gives an empty table.
    """
    return df.groupBy(F.col(key), *values).agg(F.count(F.lit(1)).alias(WEIGHT), *[c.alias(n) for n, c in extra.items()])


def heavy_keys(df: DataFrame, key: str, value: str, share: Fraction = Fraction(1, 50)) -> DataFrame:
    """Non-null keys that each hold at least ``share`` of all rows: (key, n_rows, total_rows).

    All rows count in the total, those with a null key too. At most ``1 / share`` rows
    come out, whatever the size. The rows are compressed by ``value``, a column of any
    type that tells the rows of one key apart. An empty table gives no rows.
    """
    packed = compress(df.select(F.col(key), F.col(value).alias("_value")), key, ["_value"])
    per_key = packed.groupBy(key).agg(F.sum(WEIGHT).alias("n_rows"))
    total = per_key.agg(F.sum("n_rows").alias("total_rows")).scalar()
    return (
        per_key.withColumn("total_rows", total)
        .filter(F.col(key).isNotNull() & (F.col("n_rows") * share.denominator >= F.col("total_rows") * share.numerator))
        .select(key, "n_rows", "total_rows")
    )


def value_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per non-null key: n_rows, n_values, n_distinct and mode of ``value``.

    ``n_values`` are the rows whose value isn't null; nulls take no part in n_distinct
    and mode. Of values equally frequent the smallest is the mode; a key with null values
    alone has the mode null.
    """
    packed = compress(df.filter(F.col(key).isNotNull()), key, [value])
    known = F.col(value).isNotNull()
    lead = packed.groupBy(key).agg(
        F.sum(WEIGHT).alias("n_rows"),
        F.sum(F.when(known, F.col(WEIGHT)).otherwise(0)).alias("n_values"),
        F.count(value).alias("n_distinct"),
        F.max(F.when(known, F.col(WEIGHT))).alias("_top"),
    )
    # of the values that reach the highest weight, the smallest
    modes = packed.filter(known).groupBy(key, WEIGHT).agg(F.min(value).alias("mode"))
    best = modes.groupBy(key).agg(F.max_by("mode", WEIGHT).alias("mode"))
    return lead.drop("_top").join(best, key, "left")


def weighted_percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Exact lower percentiles per non-null key: (key, share, value).

    The percentile of share s is the smallest value with at least s of the key's non-null
    rows at or below it. The compressed (key, value) pairs are range-partitioned by both,
    so a heavy key spreads over many tasks; running weights inside a partition plus each
    partition's offset per key give exact ranks without one task seeing a whole key.
    Keys without values give no rows.
    """
    packed = compress(df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()), key, [value])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(packed.repartitionByRange(parts, key, value).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(key, "_part").agg(F.sum(WEIGHT).alias("_sum"))
    by_key = Window.partitionBy(key)  # at most one row per key and partition
    before = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(by_key).alias("_all")
    )
    inside = Window.partitionBy(key, "_part").orderBy(value)
    ranks = ranged.join(offsets, [key, "_part"]).withColumn("_upto", F.sum(WEIGHT).over(inside) + F.col("_before"))
    need = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    wanted = ranks.select(key, value, WEIGHT, "_upto", "_all", need.alias("share")).withColumn(
        "_rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("_all")))
    )
    hit = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col(WEIGHT) < F.col("_rank"))
    return wanted.filter(hit).select(key, "share", value)
