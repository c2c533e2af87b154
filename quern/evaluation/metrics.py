"""Quality, cost and latency of query results, as DataFrame computations.

Each metric gives one row (or one per group). Where the result and the gold are both
empty the conventions differ by metric and are stated at each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The most rows that are matched one by one because nulls match anything.
WILD_ROWS = 20_000


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def prf(tp: Column, result: Column, gold: Column, both_empty: float = 1.0) -> list[Column]:
    """precision, recall and f1_score from counts; an empty gold gives ``both_empty`` or 0."""
    none = F.when(result == 0, F.lit(both_empty)).otherwise(0.0)
    p = F.when(gold == 0, none).otherwise(_ratio(tp, result))
    r = F.when(gold == 0, none).otherwise(_ratio(tp, gold))
    f = F.when(gold == 0, none).otherwise(_f1(p, r))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1_score")]


def _counts(tp: DataFrame, result: DataFrame, gold: DataFrame) -> DataFrame:
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("k"), "n")
    rows = one(tp, "tp").unionByName(one(result, "result")).unionByName(one(gold, "gold"))
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("tp", "result", "gold")])


def retrieval(result: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows matched one to one on the common columns.

    Repeated rows match as often as both sides have them; a null on either side matches
    any value, which is decided row by row on the driver for the rows left, ``WILD_ROWS``
    of a side at most. An empty gold gives precision 1 if the result is empty too, else 0,
    and recall and F1 of 0.
    """
    columns = [c for c in result.columns if c in gold.columns]
    number = lambda df: df.select(*columns, F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0))).alias("_rn"))
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    r, g = number(result), number(gold)
    exact = r.filter(full).join(g.filter(full), [*columns, "_rn"], "left_semi")
    r_rest = r.filter(full).join(g.filter(full), [*columns, "_rn"], "left_anti").unionByName(r.filter(~full))
    g_rest = g.filter(full).join(r.filter(full), [*columns, "_rn"], "left_anti").unionByName(g.filter(~full))
    wild = 0
    if not (r.filter(~full).isEmpty() and g.filter(~full).isEmpty()):
        sides = [[tuple(x)[:-1] for x in side.limit(WILD_ROWS + 1).collect()] for side in (r_rest, g_rest)]
        if max(map(len, sides)) > WILD_ROWS:
            raise ValueError(f"more than {WILD_ROWS} rows to match beside rows with nulls")
        wild = _greedy(*sides)
    c = _counts(exact, result, gold).withColumn("tp", F.col("tp") + wild)
    p = F.when(F.col("gold") == 0, F.when(F.col("result") == 0, 1.0).otherwise(0.0)).otherwise(_ratio(F.col("tp"), F.col("result")))
    rec = F.when(F.col("gold") == 0, 0.0).otherwise(_ratio(F.col("tp"), F.col("gold")))
    return c.select(p.alias("precision"), rec.alias("recall"), _f1(p, rec).alias("f1_score"))


def _greedy(result: list[tuple], gold: list[tuple]) -> int:
    left, hits = list(gold), 0
    for r in result:
        for i, g in enumerate(left):
            if all(a is None or b is None or a == b for a, b in zip(r, g)):
                left.pop(i)
                hits += 1
                break
    return hits


def id_set(result: DataFrame, gold: DataFrame, column: str) -> DataFrame:
    """Precision, recall and F1 of the distinct ids; both empty gives 1."""
    r, g = (df.select(column).filter(F.col(column).isNotNull()).distinct() for df in (result, gold))
    return _counts(r.join(g, column, "left_semi"), r, g).select(*prf(F.col("tp"), F.col("result"), F.col("gold")))


def limited(result: DataFrame, gold: DataFrame, column: str, limit: int) -> DataFrame:
    """For "any n rows" queries: the first ``limit`` results, recall against min(limit, gold)."""
    r = result.select(column).limit(limit).distinct()
    g = gold.select(column).distinct()
    c = _counts(r.join(g, column, "left_semi"), r, g).withColumn("gold", F.least(F.col("gold"), F.lit(limit)))
    return c.select(*prf(F.col("tp"), F.col("result"), F.col("gold")))


def padded(result: DataFrame, gold: DataFrame, column: str, limit: int) -> DataFrame:
    """For "any n rows" queries: the gold is what the result found of it, filled up with other gold rows to ``limit``.

    Every row of the result counts, so more than ``limit`` hits are an error. The choice of
    the others makes no difference, so none is drawn: precision is against all results and
    recall against min(limit, gold).
    """
    r, g = (df.select(column).filter(F.col(column).isNotNull()).distinct() for df in (result, gold))
    c = _counts(r.join(g, column, "left_semi"), r, g).withColumn("gold", F.least(F.col("gold"), F.lit(limit)))
    c = c.withColumn("tp", F.when(F.col("tp") <= limit, F.col("tp")).otherwise(F.raise_error(F.lit(f"more than {limit} hits")).cast("long")))
    return c.select(*prf(F.col("tp"), F.col("result"), F.col("gold")))


def tuples(result: DataFrame, gold: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Tuples whose order inside doesn't matter, as sets; both empty gives 1, missing columns 0."""
    if any(c not in result.columns for c in columns):
        return result.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in ("precision", "recall", "f1_score")])
    pack = lambda df: df.select(F.array_sort(F.array(*[F.col(c).cast("string") for c in columns])).alias("t")).distinct()
    r, g = pack(result.limit(limit) if limit else result), pack(gold)
    c = _counts(r.join(g, "t", "left_semi"), r, g)
    if limit:
        c = c.withColumn("gold", F.least(F.col("gold"), F.lit(limit)))
    return c.select(*prf(F.col("tp"), F.col("result"), F.col("gold")))


def list_hits(result: DataFrame, gold: DataFrame, column: str) -> DataFrame:
    """As ``id_set``, but every result row counts, repeated ones too."""
    r, g = result.select(column), gold.select(column).distinct()
    return _counts(r.join(g, column, "left_semi"), r, g).select(*prf(F.col("tp"), F.col("result"), F.col("gold")))


def top_choice(result: DataFrame, gold: DataFrame, column: str) -> DataFrame:
    """1 if the result is exactly one row and among the tied gold rows, else 0."""
    c = _counts(result.select(column).join(gold.select(column).distinct(), column, "left_semi"), result, gold)
    one = ((F.col("result") == 1) & (F.col("tp") == 1)).cast("double")
    return c.select(*[one.alias(x) for x in ("precision", "recall", "f1_score")])


def aggregate_error(result: DataFrame, column: str, gold: float) -> DataFrame:
    """absolute_error, relative_error and MAPE of a one-row result; other row counts give inf, 1 and 100.

    A gold of 0 has a relative error of 0 if met, else infinite. Numbers in strings count.
    """
    value = F.col(column).cast("string").try_cast("double")
    c = result.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("v"))
    ok = (F.col("n") == 1) & F.col("v").isNotNull()
    off = F.abs(F.col("v") - gold)
    relative = F.when(F.lit(gold) == 0, F.when(off == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(off, F.lit(abs(gold))))
    return c.select(
        F.when(ok, off).otherwise(float("inf")).alias("absolute_error"),
        F.when(ok, relative).otherwise(1.0).alias("relative_error"),
        F.when(ok, relative * 100).otherwise(100.0).alias("mean_absolute_percentage_error"),
    )


def group_count_error(result: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    """Mean relative error over the groups of either side; a missing group counts as 0."""
    g = gold.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("g"))
    r = result.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("r"))
    both = g.join(r, "_k", "full").fillna(0.0, ["g", "r"])
    error = F.when(F.col("g") == 0, F.when(F.col("r") == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(F.abs(F.col("r") - F.col("g")), F.col("g")))
    return both.agg(F.coalesce(F.avg(error), F.lit(0.0)).alias("relative_error"))


def _paired(result: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    a = result.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("a"))
    b = gold.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("b"))
    return a.join(b, key).filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def _ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks from the counts per value: one row per distinct value is sorted, not every row."""
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(column))
    return df.join(values.withColumn(name, before - (F.col("_n") - 1) / 2).drop("_n"), column)


def spearman(result: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    """Rank correlation over the common ids; fewer than two, or no spread, give 0."""
    ranked = _ranks(_ranks(_paired(result, gold, key, value), "a", "ra"), "b", "rb")
    c = ranked.agg(F.corr("ra", "rb").alias("c"), F.count(F.lit(1)).alias("n"))
    return c.select(F.when((F.col("n") < 2) | F.isnan("c"), 0.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("spearman_correlation"))


def kendall(result: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    """Kendall's tau-b over the common ids, from the counts of distinct pairs of values.

    Rows of equal values are counted together, so the pairs grow with the distinct values
    only; fewer than two ids, or no spread, give 0.
    """
    cells = _paired(result, gold, key, value).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    other = cells.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    # each unordered pair of cells once
    pairs = cells.join(other, (F.col("a") < F.col("a2")) | ((F.col("a") == F.col("a2")) & (F.col("b") < F.col("b2"))))
    sign = F.signum(F.col("a2") - F.col("a")) * F.signum(F.col("b2") - F.col("b"))
    s = pairs.agg(F.coalesce(F.sum(sign * F.col("n") * F.col("n2")), F.lit(0.0)).alias("s"))
    two = lambda x: x * (x - 1) / 2
    ties = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.coalesce(F.sum(two(F.col("m"))), F.lit(0.0)).alias("t")).scalar()
    n0 = cells.agg(two(F.coalesce(F.sum("n"), F.lit(0.0)))).scalar()
    below = F.sqrt((n0 - ties("a")) * (n0 - ties("b")))
    return s.select(F.coalesce(F.try_divide(F.col("s"), below), F.lit(0.0)).alias("kendall_tau"))


def macro_f1(result: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """Macro precision, recall and F1 over the labels, and accuracy, of rows joined by id."""
    both = gold.select(key, F.col(label).alias("g")).join(result.select(key, F.col(label).alias("r")), key)
    cells = both.groupBy("g", "r").agg(F.count(F.lit(1)).alias("n"))
    # each cell counts once for its gold label and once for its result's
    none = F.lit(0).cast("long")
    same = F.coalesce(F.col("g") == F.col("r"), F.lit(False))
    as_gold = F.struct(F.col("g").alias("l"), F.when(same, F.col("n")).otherwise(none).alias("tp"), none.alias("result"), F.col("n").alias("gold"))
    as_result = F.struct(F.col("r").alias("l"), none.alias("tp"), F.col("n").alias("result"), none.alias("gold"))
    sides = cells.select(F.explode(F.array(as_gold, as_result)).alias("s")).select("s.*").filter(F.col("l").isNotNull())
    per = sides.groupBy("l").agg(*[F.sum(c).alias(c) for c in ("tp", "result", "gold")])
    p, r = _ratio(F.col("tp"), F.col("result")), _ratio(F.col("tp"), F.col("gold"))
    accuracy = both.agg(F.coalesce(F.avg(F.coalesce(F.col("g") == F.col("r"), F.lit(False)).cast("double")), F.lit(0.0))).scalar()
    return per.select(p.alias("p"), r.alias("r"), _f1(p, r).alias("f")).agg(
        F.coalesce(F.avg("p"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("f"), F.lit(0.0)).alias("f1_score")
    ).withColumn("accuracy", accuracy)


def adjusted_rand(result: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """Adjusted Rand index over the common ids, from the contingency table; one cluster on both sides gives 1."""
    both = gold.select(key, F.col(label).alias("g")).join(result.select(key, F.col(label).alias("r")), key)
    cells = both.groupBy("g", "r").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    both_same = cells.agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias("ij"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.coalesce(F.sum(two(F.col("m"))), F.lit(0.0))).scalar()
    t = both_same.withColumns({"a": side("g"), "b": side("r")}).withColumn("e", F.try_divide(F.col("a") * F.col("b"), two(F.col("n"))))
    below = (F.col("a") + F.col("b")) / 2 - F.col("e")
    return t.select(F.coalesce(F.try_divide(F.col("ij") - F.col("e"), below), F.lit(1.0)).alias("adjusted_rand_index"))


def omega_index(result: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """Omega index of disjoint clusters: the share of pairs treated alike, corrected for chance.

    A missing category is a cluster of its own; for disjoint clusters pairs are counted
    from the contingency table, never listed.
    """
    fill = lambda df: df.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit("-1")))
    both = fill(gold).select(key, F.col(label).alias("g")).join(fill(result).select(key, F.col(label).alias("r")), key)
    cells = both.groupBy("g", "r").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.coalesce(F.sum(two(F.col("m"))), F.lit(0.0))).scalar()
    t = cells.agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias("ij"), two(F.coalesce(F.sum("n"), F.lit(0.0))).alias("all")).withColumns({"a": side("g"), "b": side("r")})
    same = F.try_divide(F.col("ij") + F.col("all") - F.col("a") - F.col("b") + F.col("ij"), F.col("all"))
    chance = F.try_divide(F.col("a") * F.col("b") + (F.col("all") - F.col("a")) * (F.col("all") - F.col("b")), F.col("all") * F.col("all"))
    return t.select(F.coalesce(F.try_divide(same - chance, 1 - chance), F.lit(1.0)).alias("omega_index"))


def evaluate(metric: str, result: DataFrame, gold: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """A metric by name."""
    if metric in ("f1-score", "precision", "recall"):
        column = {"f1-score": "f1_score"}.get(metric, metric)
        return id_set(result, gold, key).select(F.col(column).alias("value"))
    table = {"adjusted-rand-index": adjusted_rand, "omega-index": omega_index, "macro-f1": macro_f1}
    if metric not in table:
        raise ValueError(f"unknown metric: {metric}")
    out = table[metric](result, gold, key, label)
    return out.select(F.col("f1_score" if metric == "macro-f1" else out.columns[0]).alias("value"))


def quality(metrics: DataFrame) -> DataFrame:
    """``metrics`` with one ``quality`` per row: F1, else 1 / (1 + relative error), else the rank correlation, not below 0."""
    by_error = F.when(F.col("relative_error").isNotNull(), 1 / (1 + F.col("relative_error")))
    return metrics.withColumn("quality", F.coalesce(F.col("f1_score"), by_error, F.greatest(F.col("spearman_correlation"), F.lit(0.0))))


def wins(metrics: DataFrame, group: list[str], system: str, value: str, tolerance: float = 0.0, lowest: bool = False) -> DataFrame:
    """Per system how often it is best in a group; those within ``tolerance`` of the best share the point."""
    best = F.min(value) if lowest else F.max(value)
    with_best = metrics.filter(F.col(value).isNotNull()).withColumn("_b", best.over(Window.partitionBy(*group)))
    tied = with_best.filter(F.abs(F.col(value) - F.col("_b")) <= tolerance * F.abs(F.col("_b")))
    share = tied.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    return share.groupBy(system).agg(F.sum(1 / F.col("_n")).alias("wins"))


def repeats(metrics: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, standard deviation and number of repeated runs."""
    return metrics.groupBy(*group).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def pareto(metrics: DataFrame, group: list[str], system: str, cost: str, gain: str) -> DataFrame:
    """The systems that no other of their group beats in both cost and gain."""
    other = metrics.select(*group, F.col(cost).alias("_c"), F.col(gain).alias("_g"))
    better = (F.col("_c") <= F.col(cost)) & (F.col("_g") >= F.col(gain)) & ((F.col("_c") < F.col(cost)) | (F.col("_g") > F.col(gain)))
    same = reduce(lambda a, b: a & b, [metrics[g] == other[g] for g in group], F.lit(True))
    return metrics.join(other, same & better, "left_anti").select(*group, system, cost, gain)


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, text_tokens, audio_tokens, output_tokens, reasoning_tokens) with ``money_cost`` in USD.

    Reasoning tokens are billed as output; prices are per million tokens. Unknown models
    cost null.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = n("text_tokens") * F.col("text") + n("audio_tokens") * F.col("audio") + (n("output_tokens") + n("reasoning_tokens")) * F.col("output")
    return usage.join(prices, "model", "left").withColumn("money_cost", total / 1_000_000).select(*usage.columns, "money_cost")


def common(metrics: DataFrame, query: str, system: str) -> DataFrame:
    """The queries that every system answered."""
    n = metrics.select(system).distinct().agg(F.count(F.lit(1))).scalar()
    return metrics.groupBy(query).agg(F.countDistinct(system).alias("_n")).filter(F.col("_n") == n).select(query)
