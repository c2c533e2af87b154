"""The semantic operators: relational operators that a natural-language prompt configures.

Every operator takes a model, which adds its answer as a column; with models that are
expressions the whole plan stays inside the JVM and Catalyst pushes plain filters below.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.prompts import Prompt, parse_json
from quern.models.base import ExpressionModel, Model, cosine
from quern.staging import stage
from quern.tables import fresh, spread

#: A side that is joined without keys is broadcast in blocks of at most about so many rows and characters.
UNKEYED_ROWS, UNKEYED_CHARS = 100_000, 1 << 26
#: Queries of a search that are broadcast at a time, and scores that a task holds at once.
SLAB_QUERIES, SLAB_SCORES = 4096, 1 << 20


def _prompt(p: str | Prompt) -> Prompt:
    return p if isinstance(p, Prompt) else Prompt(p)


def sem_filter(df: DataFrame, prompt: str | Prompt, model: Model, default: bool = False) -> DataFrame:
    """Rows for which the prompt is true; an answer that can't be read counts as ``default``."""
    p = _prompt(prompt)
    p.check(df.columns)
    (name,) = fresh(df.columns, "_if")
    # without a default the bare answer is the filter, which Spark can push into the scan
    truth = F.coalesce(name, F.lit(True)) if default else F.col(name)
    return model.answer(df, p, name, "boolean").filter(truth).select(df.columns)


def sem_filter_any(df: DataFrame, prompt: str | Prompt, model: Model, n: int) -> DataFrame:
    """Any ``n`` rows for which the prompt is true; remote models stop asking early."""
    p = _prompt(prompt)
    p.check(df.columns)
    return model.first_true(df, p, n) if hasattr(model, "first_true") else sem_filter(df, p, model).limit(n)


def within_budget(df: DataFrame, key: str, prompt: str | Prompt, model: Model, name: str, calls: int, seed: int = 42) -> DataFrame:
    """``df`` with the answer for at most ``calls`` rows, chosen by a seeded hash of the key, and ``name_asked``.

    Rows beyond the budget have a null answer; the mean of ``name_asked`` is the coverage.
    """
    p = _prompt(prompt)
    p.check(df.columns)
    asked = stage(df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(calls).select(key), "budget")
    keyed = df.join(asked, key, "left_semi")
    answered = model.answer(keyed, p, name, "boolean").select(*df.columns, name).withColumn(f"{name}_asked", F.lit(True))
    rest = df.join(asked, key, "left_anti").select(*df.columns, F.lit(None).cast("boolean").alias(name), F.lit(False).alias(f"{name}_asked"))
    return answered.unionByName(rest)


def sem_if(df: DataFrame, prompt: str | Prompt, model: Model, name: str) -> DataFrame:
    """``df`` with the truth of the prompt as a nullable BOOLEAN column, evaluated once a row."""
    p = _prompt(prompt)
    p.check(df.columns)
    return model.answer(df, p, name, "boolean")


def sem_map(df: DataFrame, prompt: str | Prompt, model: Model, name: str, dtype: str = "string") -> DataFrame:
    """``df`` with a generated column of the given type; an existing column of that name stays as it is."""
    if name in df.columns:
        return df
    p = _prompt(prompt)
    p.check(df.columns)
    return model.answer(df, p, name, dtype)


def sem_extract(df: DataFrame, fields: Mapping[str, tuple[str, str]], model: Model) -> DataFrame:
    """``df`` with one column per field; ``fields`` gives each its prompt and type."""
    for name, (prompt, dtype) in fields.items():
        df = sem_map(df, prompt, model, name, dtype)
    return df


def sem_generate(df: DataFrame, prompt: str | Prompt, model: Model, schema: str) -> DataFrame:
    """``df`` with the fields of ``schema`` (DDL), read from an answer in JSON.

    An answer that can't be read, or lacks a field, leaves nulls; columns of these names are replaced.
    """
    p = _prompt(prompt)
    p.check(df.columns)
    (raw,) = fresh(df.columns, "_json")
    said = model.answer(df, p, raw, "string")
    read = parse_json(F.col(raw), schema)
    fields = StructType.fromDDL(schema).fieldNames()
    kept = [c for c in said.columns if c != raw and c not in fields]
    return said.withColumn(raw, read).select(*kept, *[F.col(raw)[f].alias(f) for f in fields])


def with_labels(prompt: Prompt, labels: Sequence[str] | Mapping[str, str]) -> Prompt:
    """The prompt with the labels to choose from, each with its description if it has one."""
    told = [f"- {k}: {v}" for k, v in labels.items()] if isinstance(labels, Mapping) else [f"- {k}" for k in labels]
    return Prompt("\n".join([prompt.text, "Answer with one of these labels only:", *told]))


def sem_classify(df: DataFrame, prompt: str | Prompt, labels: Sequence[str] | Mapping[str, str], model: Model, name: str) -> DataFrame:
    """``df`` with one of ``labels`` per row; an answer outside the set is null.

    ``labels`` are names, or names with descriptions. Models that read a prompt are told them;
    models that are expressions know the prompt as it is.
    """
    p = _prompt(prompt)
    p.check(df.columns)
    answered = model.answer(df, p if isinstance(model, ExpressionModel) else with_labels(p, labels), name, "string")
    return answered.withColumn(name, F.when(F.col(name).isin(*labels), F.col(name)))


def classify_nearest(df: DataFrame, key: str, vector: str, prototypes: DataFrame, label: str, prototype: str, name: str) -> DataFrame:
    """``df`` with the label of the prototype of greatest cosine; ties go to the least label.

    The prototypes go along as one array, in blocks of bounded size, so each row is scored
    where it is read and nothing is shuffled. A null vector or prototype has no similarity,
    which goes before all.
    """
    v, best = fresh(df.columns, "_protos", "_best")
    out, bests = df, []
    for k, block in enumerate(_blocks(prototypes.filter(F.col(prototype).isNotNull()).select(F.col(label).alias("l"), F.col(prototype).alias("p")))):
        packed = block.agg(F.collect_list(F.struct("l", "p")).alias(v))  # bounded by the block
        scored = F.array_min(F.transform(F.col(v), lambda x: F.struct((-F.round(cosine(F.col(vector), x["p"]), 9)).alias("s"), x["l"].alias("l"))))
        bests.append(f"{best}{k}")
        out = out.withColumn(v, packed.scalar()).withColumn(bests[-1], scored).drop(v)
    top = F.col(bests[0]) if len(bests) == 1 else F.least(*bests)
    return out.withColumn(name, top["l"]).drop(*bests)


def sem_score(df: DataFrame, prompt: str | Prompt, model: Model, name: str, low: float = 1.0, high: float = 5.0, default: float = 3.0) -> DataFrame:
    """``df`` with a score between ``low`` and ``high``; unreadable answers and those outside are ``default``."""
    p = _prompt(prompt)
    p.check(df.columns)
    (raw,) = fresh(df.columns, "_score")
    answered = model.answer(df, p, raw, "double")
    return answered.withColumn(name, F.when(F.col(raw).between(low, high), F.col(raw)).otherwise(F.lit(default))).drop(raw)


def sem_topk(df: DataFrame, score: str, k: int, tie: str, by: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The ``k`` rows of greatest score, over all or per group; ties go by ``tie``, nulls come last."""
    order = [F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last(), F.col(tie)]
    if not by:
        return df.orderBy(*order).limit(k)
    (rn,) = fresh(df.columns, "_rn")
    ranked = df.withColumn(rn, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(rn) <= k).drop(rn)


def rank_spread(df: DataFrame, score: str, tie: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks spread evenly from 5 down to 1, one decimal; a lone row gets 3.

    Over all rows (no ``by``) ranks come from a range-partitioned sort: rows before a
    partition plus the place inside it, so no task sees all rows.
    """
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    if by:
        w = Window.partitionBy(*by)
        ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    else:
        ordered = stage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ranked")
        sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # one row per partition
        w = Window.partitionBy(F.lit(0)).orderBy("_part")
        sizes = sizes.withColumns({"_before": F.sum("_rows").over(w) - F.col("_rows"), "_n": F.sum("_rows").over(Window.partitionBy(F.lit(0)))})
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
        ranked = ordered.withColumn("_in", inside).join(F.broadcast(sizes), "_part").withColumn("_i", F.col("_in") + F.col("_before")).drop("_part", "_rows", "_before", "_in")
    value = F.when(F.col("_n") == 1, 3.0).otherwise(F.round(5 - 4 * F.col("_i") / (F.col("_n") - 1), 1))
    return ranked.withColumn(name, value).drop("_i", "_n")


def best_match(df: DataFrame, key: str, value: str, score: str, name: str, ascending: bool = False) -> DataFrame:
    """Per key the value of best score; ties go to the least value."""
    order = F.struct(F.col(score) if ascending else -F.col(score), F.col(value))
    return df.groupBy(key).agg(F.min_by(value, order).alias(name))


def sem_agg(df: DataFrame, item: str, key: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The values of ``item`` that occur with every distinct ``key`` of the group: the common answer of all rows.

    Two levels of counting; nothing is collected per group but the common values.
    """
    keys = df.filter(F.col(key).isNotNull())
    total = keys.select(*by, key).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    per = keys.select(*by, key, item).distinct().filter(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count(F.lit(1)).alias("_in"))
    joined = per.join(total, list(by)) if by else per.withColumn("_all", total.scalar())
    return joined.filter(F.col("_in") == F.col("_all")).select(*by, F.col(item).alias(name))


def sem_common(df: DataFrame, prompt: str | Prompt, model: Model, key: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """What the model finds in every ``key`` of the group: it lists the items of each row as JSON, and the common ones stay."""
    p = _prompt(prompt)
    p.check(df.columns)
    (raw,) = fresh(df.columns, "_items")
    listed = model.answer(df, p, raw, "string").withColumn(raw, F.explode_outer(F.from_json(raw, "array<string>")))
    return sem_agg(listed, raw, key, name, by)


#: About so many rows, or partial answers, go into one question of ``sem_reduce``.
FAN_IN = 64


def sem_reduce(df: DataFrame, prompt: str | Prompt, model: Model, name: str, by: Sequence[str] = (), fan_in: int = FAN_IN) -> DataFrame:
    """One answer per group, or for all rows, to a prompt about many rows.

    Models that are expressions answer by an aggregate. Others are asked about ``fan_in`` rows
    at a time, then about as many partial answers, until one is left; so no question grows
    with its group. Rows with a null in the prompt's columns don't count, and a group of such
    rows only has no answer.
    """
    p = _prompt(prompt)
    p.check(df.columns)
    if isinstance(model, ExpressionModel):
        return df.groupBy(*by).agg(model.expression(p).alias(name))
    keys = {c: f"_by{k}" for k, c in enumerate(by)}
    said = F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c, _ in p.slots])
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c, _ in p.slots], F.lit(True))
    items = stage(df.filter(full).select(*by, said.alias("_said"), F.xxhash64(F.monotonically_increasing_id()).alias("_h")), "rows")
    while True:
        sizes = items.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(F.ceil(F.count(F.lit(1)) / fan_in).cast("int").alias("_parts"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()], F.lit(True))
        placed = items.join(sizes, same).select(*by, "_said", "_h", "_parts")
        asked = placed.groupBy(*by, F.pmod("_h", "_parts").alias("_part")).agg(F.array_sort(F.collect_list("_said")).alias("_said"), F.max("_parts").alias("_parts"))
        asked = stage(asked.select(*by, "_part", "_parts", F.concat(F.lit(p.text + "\n"), F.array_join("_said", "\n")).alias("_asked")), "asked")
        told = model.answers(asked.select(F.col("_asked").alias("prompt")).distinct()).select("prompt", "answer")
        answered = stage(asked.join(told, F.col("_asked") == F.col("prompt")).select(*by, "_parts", "answer", F.xxhash64("_part").alias("_h")), "answered")
        if answered.filter("_parts > 1").isEmpty():
            return answered.select(*by, F.col("answer").alias(name))
        items = answered.filter("answer IS NOT NULL").select(*by, F.col("answer").alias("_said"), "_h")


#: Rows that are compared with each other to choose where a round of ``sem_topk_by`` divides.
PIVOTS = 32


def _judged(rows: DataFrame, few: DataFrame, p: Prompt, model: Model, name: str, few_first: bool = False) -> DataFrame:
    """Every pair of a row with one of a bounded few, columns with _row and _few, and whether the prompt holds of them in that order, or the other."""
    l, r = (x.withColumnsRenamed({c: f"{c}_{side}" for c in x.columns}) for x, side in ((rows, "row"), (few, "few")))
    (at,) = fresh(l.columns + r.columns, "_few")
    packed = r.agg(F.collect_list(F.struct(*r.columns)).alias(at))  # PIVOTS rows, or as many as are asked for
    pairs = l.withColumn(at, F.explode(packed.scalar())).select(*l.columns, f"{at}.*")
    side = {"left": "few", "right": "row"} if few_first else {"left": "row", "right": "few"}
    sided = p.sided({(c, s): f"{c}_{side[s]}" for c, s in p.slots})
    if isinstance(model, ExpressionModel):
        return pairs.withColumn(name, model.expression(sided, p))
    return model.answer(pairs, sided, name, "boolean").select(*pairs.columns, name)


def sem_topk_by(df: DataFrame, prompt: str | Prompt, model: Model, k: int, key: str) -> DataFrame:
    """The ``k`` best rows by a model that compares two: ``prompt`` says that {column:left} goes before {column:right}.

    Quick selection: each round compares all rows left with one of them, both ways, and keeps
    the side that the k-th row is on; the dividing row is chosen among ``PIVOTS`` so that a
    few rounds do. Rows of which neither goes before the other are equal and go by ``key``, a
    unique column; an unclear comparison counts as no. Rows with a null in the prompt's
    columns come last. ``rank`` is 1 and up, equal for equals.
    """
    p = _prompt(prompt)
    p.check(df.columns, "left")
    p.check(df.columns, "right")
    rows, taken, need = stage(df, "rest"), [], k
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in {c for c, _ in p.slots}], F.lit(True))
    rest = rows.filter(full)
    while need > 0:
        n = rest.count()
        if n <= need:
            taken += [rest, rows.filter(~full).orderBy(key).limit(need - n)]
            break
        some = stage(rest.orderBy(F.xxhash64(key, F.lit(n)), key).limit(PIVOTS), "some")
        won = _judged(some, some, p, model, "_wins").groupBy(F.col(f"{key}_row").alias("_key")).agg(F.count_if("_wins").alias("_won"))
        ranked = [r["_key"] for r in won.orderBy(F.desc("_won"), "_key").collect()]  # PIVOTS at most
        pivot = some.filter(F.col(key) == F.lit(ranked[min(len(ranked) - 1, -(-len(ranked) * need // n))]))
        before = _judged(rest, pivot, p, model, "_before").select(*[F.col(f"{c}_row").alias(c) for c in rest.columns], "_before")
        both = _judged(before, pivot, p, model, "_after", few_first=True)
        both = stage(both.select(*[F.col(f"{c}_row").alias(c) for c in before.columns], "_after"), "judged")
        up, down = (F.coalesce(a, F.lit(False)) & ~F.coalesce(b, F.lit(False)) for a, b in ((F.col("_before"), F.col("_after")), (F.col("_after"), F.col("_before"))))
        above, equal, below = (both.filter(c).select(rest.columns) for c in (up, ~up & ~down, down))
        n_above, n_equal = above.count(), equal.count()
        if n_above >= need:
            rest = above
            continue
        taken += [above, equal.orderBy(key).limit(need - n_above)]
        need -= n_above + n_equal
        rest = below
    top = stage(reduce(DataFrame.unionByName, taken), "top") if taken else df.limit(0)
    losses = _judged(top, top.filter(full), p, model, "_wins", few_first=True).groupBy(F.col(f"{key}_row").alias("_key")).agg((F.count_if("_wins") + 1).cast("long").alias("rank"))
    n_full = top.filter(full).count()
    return top.join(losses, F.col(key) == F.col("_key"), "left").withColumn("rank", F.when(full, F.col("rank")).otherwise(n_full + 1)).drop("_key")


def group_by_signature(df: DataFrame, by: Sequence[str], functions: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Groups with one column per (function, field), named "count(x)" or "average(x)"; nulls don't count."""
    known = {"count": F.count, "average": F.avg}
    if len(functions) != len(fields) or not set(functions) <= set(known):
        raise ValueError("a function, count or average, for every field")
    return df.groupBy(*by).agg(*[known[f](c).alias(f"{f}({c})") for f, c in zip(functions, fields)])


def several_of(flags: Sequence[Column], least: int) -> Column:
    """Whether at least so many of the conditions hold; a null one doesn't."""
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags]) >= least


def _blocks(side: DataFrame) -> list[DataFrame]:
    """The rows of a side in blocks that may be broadcast; each row is in one."""
    size = side.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*side.columns)))), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size["n"] // UNKEYED_ROWS), -(-size["c"] // UNKEYED_CHARS))
    if blocks == 1:
        return [side]
    (at,) = fresh(side.columns, "_block")
    placed = stage(side.withColumn(at, F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "blocks")
    return [placed.filter(F.col(at) == k).drop(at) for k in range(blocks)]


def _names(left: DataFrame, right: DataFrame, suffixes: tuple[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    clash = set(left.columns) & set(right.columns)
    return tuple({c: c + s if c in clash else c for c in side.columns} for side, s in zip((left, right), suffixes))


def sem_join(
    left: DataFrame, right: DataFrame, prompt: str | Prompt, model: Model, on: Sequence[tuple[str, str]] = (), how: str = "inner",
    unlike: tuple[str, str] | None = None, suffixes: tuple[str, str] = ("_left", "_right"), row_id: str | None = None,
) -> DataFrame:
    """Pairs for which the prompt is true.

    ``on`` are equal keys, by which the pairs are blocked first; without any the right side
    is broadcast in blocks of bounded size, as a stated query set. ``unlike`` leaves out pairs with equal ids.
    Clashing names get ``suffixes``. With how='left' the matches are found by an inner
    join and joined back by ``row_id``, a unique column of the left side, as Spark takes no
    Python function in the condition of an outer join. Null keys match nothing.
    """
    p = _prompt(prompt)
    p.check(left.columns, "left")
    p.check(right.columns, "right")
    ln, rn = _names(left, right, suffixes)
    l, r = left.withColumnsRenamed(ln), right.withColumnsRenamed(rn)
    if on:
        pairs = l.join(r, [F.col(ln[a]) == F.col(rn[b]) for a, b in on])
    else:
        pairs = reduce(DataFrame.unionByName, [l.join(F.broadcast(block)) for block in _blocks(r)])
    if unlike:
        pairs = pairs.filter(F.col(ln[unlike[0]]) != F.col(rn[unlike[1]]))
    sided = p.sided({(c, s): (ln if s == "left" else rn if s == "right" else ln | rn)[c] for c, s in p.slots})
    if isinstance(model, ExpressionModel):  # its answers are known by the prompt as written
        answered = pairs.withColumn("_if", model.expression(sided, p))
    else:
        answered = model.answer(pairs, sided, "_if", "boolean")
    matched = answered.filter("_if").select(pairs.columns)
    if how == "inner":
        return matched
    if how != "left" or row_id is None:
        raise ValueError("how is 'inner', or 'left' with row_id")
    found = matched.select(F.col(ln[row_id]).alias("_row"), *rn.values())
    return l.join(found, F.col(ln[row_id]) == F.col("_row"), "left").drop("_row")


def join_cascade(pairs: DataFrame, similarity: Column, accept: float, reject: float, oracle: Column) -> DataFrame:
    """Pairs accepted by a cheap similarity, or by the oracle where that is undecided, with ``decided_by``.

    Similarities of at least ``accept`` are taken, those below ``reject`` dropped, and only
    those between asked of the oracle; null similarities are dropped.
    """
    s = pairs.withColumn("_s", similarity)
    sure = s.filter(F.col("_s") >= accept).withColumn("decided_by", F.lit("proxy"))
    asked = s.filter((F.col("_s") >= reject) & (F.col("_s") < accept)).filter(oracle).withColumn("decided_by", F.lit("oracle"))
    return sure.unionByName(asked).drop("_s")


def cascade_thresholds(sample: DataFrame, similarity: str, truth: str, recall: float = 0.8, precision: float = 0.8) -> tuple[float, float]:
    """(accept, reject) from a labelled sample of pairs.

    ``reject`` is the greatest similarity that keeps ``recall`` of the true pairs,
    ``accept`` the least from which on ``precision`` of the pairs are true. The sample is
    reduced to one row per hundredth of similarity before it comes to the driver.
    """
    bins = sample.groupBy(F.floor(F.col(similarity) * 100).cast("int").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("int")).alias("t")
    )
    rows = sorted((r["b"], r["n"], r["t"] or 0) for r in bins.filter(F.col("b").isNotNull()).collect())
    total, n, t = sum(r[2] for r in rows), 0, 0
    accept, reject = 1.0, -1.0
    for b, rn, rt in reversed(rows):
        n, t = n + rn, t + rt
        if t >= precision * n:
            accept = b / 100
        if reject == -1.0 and t >= recall * total:
            reject = b / 100
    return max(accept, reject), reject


def retrieve(df: DataFrame, key: str, vector: str, query: Sequence[float], n: int, rerank: Column | None = None, least: float | None = None) -> DataFrame:
    """The ``n`` rows nearest to a query vector: (key, similarity), and of those the ones whose ``rerank`` reaches ``least``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = df.withColumn("similarity", F.round(cosine(F.col(vector), q), 9)).orderBy(F.col("similarity").desc_nulls_last(), key).limit(n)
    if rerank is not None:
        top = top.withColumn("_r", rerank).filter(F.col("_r") >= F.lit(least)).drop("_r")
    return top


def _best_of(slab, n: int):
    """The ``n`` nearest of a partition's (key, vector) per query of the slab; as many rows again are merged at a time."""

    def top(ids: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -s, q))
        ids, s, q = ids[order], s[order], q[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < n
        return ids[kept], s[kept], q[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = slab.value
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        step = max(1, SLAB_SCORES // len(query_ids))
        for batch in batches:
            ids, v = _vectors(batch.column(0), batch.column(1), matrix.shape[1])
            for i in range(0, len(ids), step):
                s = np.round(v[i : i + step] @ matrix.T, 9).T
                least = np.full(len(query_ids), -np.inf)
                if len(best[0]):  # a query that has n rows takes none below its last
                    counts = np.bincount(best[2], minlength=len(query_ids))
                    full = np.flatnonzero(counts >= n)
                    least[full] = best[1][np.cumsum(counts)[full] - 1]
                q, at = np.nonzero(s >= least[:, None])
                best = top(np.concatenate([best[0], ids[i + at]]), np.concatenate([best[1], s[q, at]]), np.concatenate([best[2], q]))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[2]]), pa.array(best[0]), pa.array(best[1])], names=["query_id", "key", "similarity"])

    return run


def _vectors(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows of length 1) of the vectors of that width that have a direction."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    ids, vectors = ids.filter(sized), vectors.filter(sized)
    v = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.sqrt((v * v).sum(axis=1))
    ok = norm > 0  # false for a null or NaN inside, too
    return ids.to_numpy(zero_copy_only=False)[ok], v[ok] / norm[ok, None]


def retrieve_many(df: DataFrame, key: str, vector: str, queries: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows nearest to each query vector: (query_id, key, similarity).

    ``queries`` has the columns of ``key`` and ``vector``, both BIGINT and ARRAY<FLOAT> as
    in ``df``. Slabs of about ``SLAB_QUERIES`` queries are broadcast one after the other,
    scored in blocks against all rows, and each task sends its best ``n`` a query only, so
    neither memory nor shuffle grows with rows times queries. Ties go to the least key;
    null keys, and vectors without direction or of another length than the queries', have
    no similarity and give no rows.
    """
    spark = df.sparkSession
    asked = stage(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL"), "queries")
    rows = df.select(F.col(key).cast("long"), vector).filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    slabs, parts = -(-shape["n"] // SLAB_QUERIES), []
    for k in range(slabs):
        some = asked.filter(F.pmod(F.xxhash64("id"), F.lit(slabs)) == k).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        ids, matrix = _vectors(some.column(0).combine_chunks(), some.column(1).combine_chunks(), shape["width"])
        if len(ids):
            parts.append(spread(rows).mapInArrow(_best_of(spark.sparkContext.broadcast((ids, matrix)), n), "query_id long, key long, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"query_id long, {key} long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "key")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    return ranked.select("query_id", F.col("key").alias(key), "similarity")


def answer_templates(df: DataFrame, template: str, model: Model, name: str) -> DataFrame:
    """Question answering with a question per row, made from ``<column>`` placeholders; equal rows ask once.

    The model sees the distinct combinations of the columns that the question uses.
    """
    prompt = Prompt(template.replace("<", "{").replace(">", "}"))
    columns = [c for c, _ in prompt.slots]
    keys = {c: f"_asked{k}" for k, c in enumerate(columns)}
    answered = model.answer(df.select(*columns).distinct(), prompt, name).select(*columns, name).withColumnsRenamed(keys)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return df.join(answered, same, "left").drop(*keys.values())


def new_only(known: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't known yet, one per key: what an incremental ingest has to work on."""
    return incoming.filter(F.col(key).isNotNull()).join(known.select(key), key, "left_anti").dropDuplicates([key])
