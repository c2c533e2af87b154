"""Plans as data: a list of JSON steps, checked against a registry of tools and run in order.

This stands where other systems let a model write code: a planner gives steps, nothing is
evaluated but SQL expressions from a checked set of functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.catalog import Catalog, lookup, value_index
from quern.models.base import ModelRegistry
from quern.operators import semantic

#: Functions that an expression step may use.
ALLOWED = frozenset(
    "abs ceil floor round bround lower upper trim length char_length substring split split_part element_at concat concat_ws coalesce if nullif "
    "cast try_cast date_trunc year month day datediff to_date try_to_timestamp regexp_extract regexp_replace replace get_json_object greatest least "
    "array_contains size startswith endswith contains case when in and or not like between".split()
)


@dataclass
class Step:
    tool: str
    inputs: list[str]
    output: str
    arguments: dict = field(default_factory=dict)


class PlanError(ValueError):
    """A step that can't run, with the phase that should mend it."""

    def __init__(self, message: str, phase: str, step: int):
        super().__init__(f"step {step}: {message}")
        self.phase, self.step = phase, step


def check_expression(text: str) -> str:
    """The expression, if it calls allowed functions only."""
    for name in re.findall(r"\b([a-z_]\w*)\s*\(", text.lower()):
        if name not in ALLOWED:
            raise ValueError(f"{name} isn't allowed in an expression")
    if re.search(r";|--|/\*|\bselect\b", text, re.IGNORECASE):
        raise ValueError("an expression is a single value, not a statement")
    return text


def _sql(c: Catalog, r: ModelRegistry, dfs: list[DataFrame], a: dict) -> DataFrame:
    if not re.match(r"\s*(select|with)\b", a["query"], re.IGNORECASE):
        raise ValueError("only SELECT is allowed")
    out = next(iter(c.base.values())).sparkSession.sql(a["query"])
    keep, seen = [], set()
    for k, name in enumerate(out.columns):  # of columns of one name the first stays
        if name not in seen:
            keep.append(k)
        seen.add(name)
    return out.toDF(*[f"_{k}" for k in range(len(out.columns))]).select(*[F.col(f"_{k}").alias(out.columns[k]) for k in keep])


TOOLS: dict[str, Callable[[Catalog, ModelRegistry, list[DataFrame], dict], DataFrame]] = {
    "sql": _sql,
    "filter": lambda c, r, d, a: d[0].filter(F.expr(check_expression(a["condition"]))),
    "transform": lambda c, r, d, a: d[0].withColumn(a["column"], F.expr(check_expression(a["expression"]))),
    "sem_filter": lambda c, r, d, a: semantic.sem_filter(d[0], a["prompt"], r.models[a["model"]]),
    "text_qa": lambda c, r, d, a: semantic.answer_templates(d[0], a["question"], r.models[a["model"]], a["column"]),
    "visual_qa": lambda c, r, d, a: semantic.sem_map(d[0], a["question"], r.models[a["model"]], a["column"], a.get("dtype", "string")),
    "image_select": lambda c, r, d, a: d[0].join(semantic.retrieve(d[1], a["key"], a["vector"], a["query"], a.get("n", 100)).select(a["key"]), a["key"], "left_semi"),
    "join": lambda c, r, d, a: d[0].join(d[1], a["on"], a.get("how", "inner")),
    "noop": lambda c, r, d, a: d[0],
}


def parse(text: str) -> list[Step]:
    """Steps from JSON; steps that only check something are left out."""
    steps = [Step(s["tool"], list(s.get("inputs", [])), s["output"], dict(s.get("arguments", {}))) for s in json.loads(text)]
    return [s for s in steps if s.tool not in ("verify", "check")]


def execute(text: str, catalog: Catalog, registry: ModelRegistry, strict_empty: bool = False) -> DataFrame:
    """Run a plan; the last step's table is the answer. Results shadow base tables of their name."""
    try:
        steps = parse(text)
    except (ValueError, KeyError, TypeError) as e:
        raise PlanError(str(e), "planning", 0) from e
    for k, s in enumerate(steps, 1):
        if s.tool not in TOOLS:
            raise PlanError(f"no tool {s.tool}; there are {', '.join(TOOLS)}", "mapping", k)
        try:
            catalog.put(s.output, TOOLS[s.tool](catalog, registry, [catalog.table(x) for x in s.inputs], s.arguments), strict_empty)
        except KeyError as e:
            raise PlanError(str(e), "discovery" if "no table" in str(e) else "mapping", k) from e
        except Exception as e:
            raise PlanError(str(e), "mapping", k) from e
    return catalog.result()


def attempt(planner: Callable[[list[str]], str], catalog: Catalog, registry: ModelRegistry, errors: int = 3, strict_empty: bool = False) -> DataFrame:
    """Ask a planner for a plan, and again with the errors so far while it fails, ``errors`` times at most."""
    told: list[str] = []
    while True:
        try:
            return execute(planner(told), catalog, registry, strict_empty)
        except PlanError as e:
            told.append(f"{e.phase}: {e}")
            catalog.clear()
            if len(told) > errors:
                raise


def relevant_columns(catalog: Catalog, words: DataFrame, column: str) -> DataFrame:
    """For each asked text, which string columns of which tables hold values like it: (asked, table, column, value, shared)."""
    out = None
    for name, df in sorted(catalog.base.items()):
        for f in df.schema.fields:
            if f.dataType.simpleString() == "string" and not f.metadata.get("hidden"):
                hits = lookup(value_index(df, f.name), words, column, 1).select(F.col(column).alias("asked"), F.lit(name).alias("table"), F.lit(f.name).alias("column"), "value", "shared")
                out = hits if out is None else out.unionByName(hits)
    return out
