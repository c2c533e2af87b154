"""A catalogue of tables: modality and hidden columns as metadata, links, join paths, a value index."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES = ("TEXT", "IMAGE", "AUDIO")
GRAM, PAD = 5, "####"


def describe(df: DataFrame, modality: dict[str, str] | None = None, hidden: list[str] | None = None) -> DataFrame:
    """``df`` with column metadata: modality (one of MODALITIES) and hidden."""
    for c in {*(modality or {}), *(hidden or [])}:
        meta = dict(df.schema[c].metadata)
        if c in (modality or {}):
            if modality[c] not in MODALITIES:
                raise ValueError(f"unknown modality: {modality[c]}")
            meta["modality"] = modality[c]
        if c in (hidden or []):
            meta["hidden"] = True
        df = df.withMetadata(c, meta)
    return df


def visible(df: DataFrame) -> DataFrame:
    """The columns that models other than the gold one may see."""
    return df.select([f.name for f in df.schema.fields if not f.metadata.get("hidden")])


@dataclass
class Catalog:
    """Base tables and a working set that shadows them, with the history of results."""

    base: dict[str, DataFrame] = field(default_factory=dict)
    working: dict[str, DataFrame] = field(default_factory=dict)
    history: list[str] = field(default_factory=list)
    links: list[tuple[str, str, str, str]] = field(default_factory=list)
    descriptions: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, description: str = "") -> DataFrame:
        self.base[name] = df
        self.descriptions[name] = description
        df.createOrReplaceTempView(name)
        return df

    def link(self, table: str, column: str, other: str, other_column: str) -> None:
        self.links.append((table, column, other, other_column))

    def table(self, name: str) -> DataFrame:
        if name in self.working:
            return self.working[name]
        if name in self.base:
            return self.base[name]
        raise KeyError(f"no table {name}; do you mean {', '.join(self.suggest(name, [*self.working, *self.base]))}?")

    def put(self, name: str, df: DataFrame, strict_empty: bool = False) -> DataFrame:
        """Register a result. With ``strict_empty`` an empty one is an error."""
        if strict_empty and df.isEmpty():
            raise ValueError(f"{name} is empty: check the filter or join conditions")
        self.working[name] = df
        self.history.append(name)
        df.createOrReplaceTempView(name)
        return df

    def result(self) -> DataFrame:
        return self.table(self.history[-1])

    def clear(self) -> None:
        self.working.clear()
        self.history.clear()
        for name, df in self.base.items():
            df.createOrReplaceTempView(name)

    def join_path(self, start: str, goal: str) -> list[tuple[str, str, str, str]] | None:
        """The shortest chain of links from one table to another; None if there is none."""
        queue, seen = deque([(start, [])]), {start}
        while queue:
            at, path = queue.popleft()
            if at == goal:
                return path
            for a, ac, b, bc in self.links:
                for edge in ((a, ac, b, bc), (b, bc, a, ac)):
                    if edge[0] == at and edge[2] not in seen:
                        seen.add(edge[2])
                        queue.append((edge[2], [*path, edge]))
        return None

    def joined(self, start: str, goal: str, how: str = "inner") -> DataFrame:
        """Tables joined along the path; of columns of one name the first stays."""
        path = self.join_path(start, goal)
        if path is None:
            raise ValueError(f"no links lead from {start} to {goal}")
        out = self.table(start)
        for _, column, other, other_column in path:
            right = self.table(other).withColumnRenamed(other_column, "_key")
            new = [c for c in right.columns if c not in out.columns]
            out = out.join(right.select(*new), out[column] == F.col("_key"), how).drop("_key")
        return out

    @staticmethod
    def suggest(name: str, names: list[str], n: int = 3) -> list[str]:
        """The names most like one that isn't there."""

        def distance(a: str, b: str) -> int:
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                before, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
            return row[-1]

        return sorted(names, key=lambda x: (distance(name.lower(), x.lower()) / max(len(name), len(x), 1), x))[:n]


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters of a lower-case text padded at both ends."""
    padded = F.concat(F.lit(PAD[: n - 1]), F.lower(text), F.lit(PAD[: n - 1]))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n))))


def value_index(df: DataFrame, column: str) -> DataFrame:
    """(gram, value): one row per run of characters of each distinct value."""
    values = df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return values.select(F.explode(grams(F.col("value"))).alias("gram"), "value")


def lookup(index: DataFrame, wanted: DataFrame, column: str, n: int = 3) -> DataFrame:
    """For each wanted text the ``n`` values of the index that share most runs: (column, value, shared, place)."""
    from pyspark.sql import Window

    asked = wanted.select(column).distinct().select(column, F.explode(grams(F.col(column))).alias("gram"))
    shared = asked.join(index, "gram").groupBy(column, "value").agg(F.count(F.lit(1)).alias("shared"))
    place = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("shared"), "value"))
    return shared.withColumn("place", place).filter(F.col("place") <= n)
