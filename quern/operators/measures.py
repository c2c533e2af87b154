"""Quantities in different units and scales, brought to common units."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scores import MAY_STATE, Score, parse_score, stated_scale
from quern.functions.units import DIMENSIONS, canonical, quantities, unit_of
from quern.tables import fresh

#: A source's habit decides a bare number only if it covers this share of its other scores.
HABIT_SHARE = Fraction(3, 5)
#: Parts of a source's rows that are joined with copies of its habit.
PARTS = 16

_PARSED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("grade", T.StringType()),
        T.StructField("milli", T.LongType()),
    ]
)
_NOTHING = ("none", None, None, None, None)


def _told(raw: str, text: str | None = None) -> tuple:
    s = parse_score(raw)
    if s.kind == "none":
        return _NOTHING
    if s.kind == "bare" and text is not None and (scale := stated_scale(text)):
        s = Score("scaled", s.value, scale)
    return s.kind, None if s.value is None else float(s.value), None if s.scale is None else float(s.scale), s.grade, s.milli


@F.pandas_udf(_PARSED)
def _parse(score: pd.Series, text: pd.Series) -> pd.DataFrame:
    """What each score says; a notation is parsed once a batch, and again with each text where it is bare."""
    code, notations = pd.factorize(score)
    told = [*[_told(x) for x in notations], _NOTHING]  # the last for nulls, whose code is -1
    bare = np.array([x[0] == "bare" for x in told])
    code = np.where(code < 0, len(notations), code)
    asked = np.flatnonzero(bare[code] & text.notna().to_numpy())
    told += [_told(notations[code[i]], text.iloc[i]) for i in asked.tolist()]
    code[asked] = len(notations) + 1 + np.arange(len(asked))
    return pd.DataFrame(told, columns=["kind", "value", "scale", "grade", "milli"]).astype({"milli": "Int64"}).iloc[code]


def _may_be_bare(score: Column) -> Column:
    """False only for notations that can't be bare: with signs of a scale, or a stroke that isn't a mixed number's."""
    return ~score.rlike("[%★⭐✭☆✩]") & (~score.rlike("[/⁄]") | score.rlike(r"\d\s+[1-3]\s*[/⁄]\s*[2-4]"))


def source_scales(df: DataFrame, score: str, source: str) -> DataFrame:
    """The scale that each source otherwise uses: (source, habit).

    Counts every score of the source that tells its own scale. A source without a scale
    that holds ``HABIT_SHARE`` of them has no row; so has the null source.
    """
    told = (
        df.select(source, score)
        .filter(F.col(source).isNotNull() & F.col(score).isNotNull())
        .groupBy(source, score)  # value-frequency compression: each notation is parsed once a source
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_s", _parse(F.col(score), F.lit(None).cast("string")))
        .filter(F.col("_s.kind").isin("scaled", "grade"))
        .groupBy(source, F.coalesce(F.when(F.col("_s.kind") == "scaled", F.col("_s.scale")), F.lit(-1.0)).alias("_scale"))
        .agg(F.sum("_n").alias("_n"))
    )
    top = told.groupBy(source).agg(F.max(F.struct("_n", "_scale")).alias("_top"), F.sum("_n").alias("_all"))
    kept = (F.col("_top._n") * HABIT_SHARE.denominator >= F.col("_all") * HABIT_SHARE.numerator) & (F.col("_top._scale") > 0)
    # a scale of 1 is the same habit as one of 100 written as a fraction
    return top.filter(kept).select(source, F.col("_top._scale").alias("habit"))


def score_milli(df: DataFrame, score: str, text: str, source: str, grades: DataFrame) -> DataFrame:
    """``df`` with ``score_milli``: thousandths of the full scale, rounded half up.

    The scale is the one in the field, else the one stated in the row's text, else the
    habit of its source. ``grades`` (grade, pct) says what letter grades are worth. The
    result is null for nulls, entries without a value, values above their scale and
    scales that can't be told. All rows and columns of ``df`` stay, but for a column of
    that name, which is replaced; of a grade listed twice any worth is taken.
    """
    kept = [c for c in df.columns if c != "score_milli"]
    s, key, habit, grade, pct, part, mine = fresh(df.columns, "_s", "_source", "_habit", "_grade", "_pct", "_part", "_mine")
    parsed = df.withColumn(s, _parse(F.col(score), F.when(_may_be_bare(F.col(score)) & F.col(text).rlike(MAY_STATE), F.col(text))))
    habits = source_scales(df, score, source).select(F.col(source).alias(key), F.col("habit").alias(habit))
    worth = grades.select(F.col("grade").alias(grade), F.col("pct").alias(pct)).dropDuplicates([grade])
    # only rows that need the habit carry its key, in several parts a source: neither they nor the others may meet in one task
    needs = (F.col(f"{s}.kind") == "bare") & F.col(source).isNotNull()
    habits = habits.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    needy = parsed.filter(needs).withColumn(mine, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    needy = needy.join(habits, (F.col(source) == F.col(key)) & (F.col(mine) == F.col(part)), "left").drop(mine, part)
    rest = parsed.filter(~needs).withColumns({key: F.lit(None).cast("string"), habit: F.lit(None).cast("double")})
    both = needy.unionByName(rest).join(worth, F.col(f"{s}.grade") == F.col(grade), "left")
    by_habit = F.when(F.col(f"{s}.value") <= F.col(habit), F.floor(1000 * F.col(f"{s}.value") / F.col(habit) + F.lit(0.5 + 1e-9)))
    value = (
        F.when(F.col(f"{s}.kind") == "scaled", F.col(f"{s}.milli"))
        .when(F.col(f"{s}.kind") == "grade", 10 * F.col(pct).cast("long"))
        .when(F.col(f"{s}.kind") == "bare", by_habit)
    )
    return both.select(*kept, value.cast("long").alias("score_milli"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("starts_at", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("dims", T.ArrayType(T.IntegerType()))])))
def _found(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [(at, float(v), list(d)) for at, v, d in quantities(t)] if isinstance(t, str) else [])


def text_quantities(df: DataFrame, text: str) -> DataFrame:
    """One row per number with a unit in ``text``: starts_at, value, dims beside ``df``'s columns.

    ``value`` is in the coherent SI unit of the exponent vector ``dims`` over
    ``DIMENSIONS``. Null and empty texts give no rows; columns of those names are replaced.
    """
    (q,) = fresh(df.columns, "_q")
    kept = [c for c in df.columns if c not in ("starts_at", "value", "dims")]
    return df.withColumn(q, F.explode(_found(F.col(text)))).select(*kept, f"{q}.starts_at", f"{q}.value", f"{q}.dims")


def to_canonical(df: DataFrame, value: str, unit: str, name: str = "canonical") -> DataFrame:
    """``df`` with ``name``: the value in the coherent unit, and ``name_dims``, its dimensions.

    Both are null where the value or unit is null or the unit is unknown.
    """

    @F.pandas_udf(T.StructType([T.StructField("v", T.DoubleType()), T.StructField("d", T.ArrayType(T.IntegerType()))]))
    def convert(v: pd.Series, u: pd.Series) -> pd.DataFrame:
        units = [unit_of(x) if isinstance(x, str) else None for x in u]
        ok = [k is not None and pd.notna(x) for x, k in zip(v, units)]
        return pd.DataFrame(
            {
                "v": [float(canonical(Fraction(str(x)), k)) if good else None for x, k, good in zip(v, units, ok)],
                "d": [list(k.dims) if good else None for k, good in zip(units, ok)],
            }
        )

    (c,) = fresh(df.columns, "_c")
    both = df.withColumn(c, convert(F.col(value).cast("double"), F.col(unit)))
    kept = [x for x in df.columns if x not in (name, f"{name}_dims")]
    return both.select(*kept, F.col(f"{c}.v").alias(name), F.col(f"{c}.d").alias(f"{name}_dims"))


__all__ = ["DIMENSIONS", "HABIT_SHARE", "score_milli", "source_scales", "text_quantities", "to_canonical"]
