"""A small plan over tables with semantic steps, and its rewrites before it becomes DataFrames.

Catalyst optimises what it can see. The plan adds what it can't: which semantic predicate
is cheaper, that a costly one should run behind a selective join, and that a sub-result
with model answers that is used twice should be worked out once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.models.base import Model
from quern.operators import semantic
from quern.staging import stage


@dataclass
class Node:
    inputs: list[Node] = field(default_factory=list)

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        raise NotImplementedError


@dataclass
class Scan(Node):
    df: DataFrame | None = None

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        return self.df


@dataclass
class Filter(Node):
    condition: Column | None = None

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        return run(self.inputs[0], done).filter(self.condition)


@dataclass
class Rel(Node):
    """Any relational step."""

    step: Callable[..., DataFrame] = lambda df: df

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        return self.step(*[run(x, done) for x in self.inputs])


@dataclass
class SemFilter(Node):
    prompt: str = ""
    model: Model | None = None
    default: bool = False
    price: float = 1.0
    selectivity: float = 0.5

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        return semantic.sem_filter(run(self.inputs[0], done), self.prompt, self.model, self.default)


@dataclass
class SemMap(Node):
    prompt: str = ""
    model: Model | None = None
    name: str = ""
    dtype: str = "string"

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        return semantic.sem_map(run(self.inputs[0], done), self.prompt, self.model, self.name, self.dtype)


@dataclass
class Join(Node):
    on: list[tuple[str, str]] = field(default_factory=list)
    how: str = "inner"
    selective: bool = False

    def build(self, done: dict[int, DataFrame]) -> DataFrame:
        left, right = (run(x, done) for x in self.inputs)
        renamed = {b: f"_{b}" for _, b in self.on}
        right = right.withColumnsRenamed(renamed)
        condition = [left[a] == right[renamed[b]] for a, b in self.on]
        return left.join(right, condition, self.how).drop(*renamed.values())


def parents(node: Node) -> dict[int, int]:
    """How many inputs name each node of a plan."""
    count: dict[int, int] = {}

    def visit(x: Node) -> None:
        for i in x.inputs:
            count[id(i)] = count.get(id(i), 0) + 1
            if count[id(i)] == 1:
                visit(i)

    visit(node)
    return count


def _rebuilt(node: Node, rule: Callable[[Node, dict[int, int]], Node]) -> Node:
    """The plan with every node replaced by ``rule`` of it over its rebuilt inputs; a shared node stays one node.

    ``rule`` gets a node that no other plan holds and the parents of each new node; it
    makes new nodes and changes none.
    """
    count, done, new_count = parents(node), {}, {}

    def visit(x: Node) -> Node:
        if id(x) not in done:
            done[id(x)] = rule(replace(x, inputs=[visit(i) for i in x.inputs]), new_count)
            new_count[id(done[id(x)])] = count.get(id(x), 0)
        return done[id(x)]

    return visit(node)


def _rank(f: Node) -> tuple[int, float]:
    return (0, 0.0) if isinstance(f, Filter) else (1, f.price / max(1e-9, 1 - f.selectivity))


def order_filters(node: Node) -> Node:
    """In a chain of filters plain ones go first, then semantic ones by price over what they remove.

    A filter that several steps read ends a chain: what they get from it mustn't change.
    """

    def rule(x: Node, count: dict[int, int]) -> Node:
        if not isinstance(x, (Filter, SemFilter)):
            return x
        chain, at = [x], x.inputs[0]
        while isinstance(at, (Filter, SemFilter)) and count.get(id(at)) == 1:
            chain.append(at)
            at = at.inputs[0]
        out = at
        for f in sorted(reversed(chain), key=_rank):
            out = replace(f, inputs=[out])
            count[id(out)] = 1
        return out

    return _rebuilt(node, rule)


def delay_past_joins(node: Node) -> Node:
    """A semantic filter under a selective inner join moves above it, so the model sees only rows that join.

    One that other steps read too stays where it is, to be worked out once.
    """

    def rule(x: Node, count: dict[int, int]) -> Node:
        if not (isinstance(x, Join) and x.selective and x.how == "inner"):
            return x
        above = []
        while isinstance(x.inputs[0], SemFilter) and count.get(id(x.inputs[0])) == 1:
            above.append(x.inputs[0])
            x = replace(x, inputs=[x.inputs[0].inputs[0], *x.inputs[1:]])
        for f in reversed(above):
            x = replace(f, inputs=[x])
            count[id(x)] = 1
        return x

    return _rebuilt(node, rule)


def shared_nodes(node: Node) -> set[int]:
    """Nodes with model answers that several steps read."""
    seen: dict[int, int] = {}
    semantic_nodes: set[int] = set()

    def visit(x: Node) -> bool:
        seen[id(x)] = seen.get(id(x), 0) + 1
        uses = [visit(i) for i in x.inputs] if seen[id(x)] == 1 else [id(x) in semantic_nodes]
        has = isinstance(x, (SemFilter, SemMap)) or any(uses)
        if has:
            semantic_nodes.add(id(x))
        return has

    visit(node)
    return {k for k, n in seen.items() if n > 1 and k in semantic_nodes}


def run(node: Node, done: dict[int, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of a plan; shared semantic sub-results are staged once."""
    if done is None:
        done = {}
        done[-1] = shared_nodes(node)
    if id(node) not in done:
        df = node.build(done)
        done[id(node)] = stage(df, "shared") if id(node) in done[-1] else df
    return done[id(node)]


def optimise(node: Node) -> Node:
    return delay_past_joins(order_filters(node))


def union_of(column: str, *branches: DataFrame) -> DataFrame:
    """The distinct values of a column over several branches."""
    out = branches[0].select(column)
    for b in branches[1:]:
        out = out.unionByName(b.select(column))
    return out.distinct()


def in_all(column: str, *branches: DataFrame) -> DataFrame:
    """The distinct values of a column that every branch has, by one aggregation instead of chained joins."""
    out = None
    for k, b in enumerate(branches):
        one = b.select(column).withColumn("_b", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct("_b").alias("_n")).filter(F.col("_n") == len(branches)).select(column)
