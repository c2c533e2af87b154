"""Natural-language instructions with column placeholders.

``{col}`` names a column; ``{col:left}`` and ``{col:right}`` name a side of a join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{([^{}:]+)(?::(left|right))?\}")


@dataclass(frozen=True)
class Prompt:
    text: str

    @property
    def key(self) -> str:
        """The instruction without case and spacing, by which models know it."""
        return re.sub(r"\s+", " ", self.text).strip().lower()

    @property
    def slots(self) -> list[tuple[str, str | None]]:
        """(column, side) of each placeholder in order, without repeats."""
        return list(dict.fromkeys((m[1], m[2]) for m in _SLOT.finditer(self.text)))

    def check(self, columns: list[str], side: str | None = None) -> None:
        missing = [c for c, s in self.slots if s == side and c not in columns]
        if missing:
            raise ValueError(f"the prompt names columns that aren't there: {', '.join(missing)}")

    def sided(self, names: dict[tuple[str, str | None], str]) -> Prompt:
        """The prompt with each slot replaced by the column that it is named after a join."""
        return Prompt(_SLOT.sub(lambda m: "{" + names[(m[1], m[2])] + "}", self.text))

    def render(self) -> Column:
        """The text with each row's values filled in; null if a value is null."""
        parts, last = [], 0
        for m in _SLOT.finditer(self.text):
            parts += [F.lit(self.text[last : m.start()]), F.col(m[1]).cast("string")]
            last = m.end()
        return F.concat(*parts, F.lit(self.text[last:]))


def parse_boolean(answer: Column) -> Column:
    """TRUE or FALSE in a free answer; null if it says both or neither."""
    low = F.lower(answer)
    yes, no = low.rlike(r"\b(true|yes)\b"), low.rlike(r"\b(false|no)\b")
    return F.when(yes & ~no, True).when(no & ~yes, False)


def parse_between_tags(answer: Column, tag: str) -> Column:
    """The text between <tag> and </tag>; null if there is none."""
    found = F.regexp_extract(answer, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    return F.when(answer.rlike(rf"(?s)<{tag}>.*</{tag}>"), found)


def parse_json(answer: Column, schema: str) -> Column:
    """The first JSON object in an answer, read by ``schema``; null if there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), schema)


def to_number(answer: Column) -> Column:
    """A number in digits or as an English word from zero to twelve; null if neither."""
    # The first number words.
    words = "zero one two three four five six seven eight nine ten eleven twelve".split()
    table = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, float(i))])
    text = F.lower(F.trim(answer))
    return F.coalesce(text.try_cast("double"), F.try_element_at(table, text))


def to_boolean(answer: Column) -> Column:
    """true, yes, 1 and false, no, 0, whatever their case; null for all else."""
    text = F.lower(F.trim(answer))
    return F.when(text.isin("true", "yes", "1"), True).when(text.isin("false", "no", "0"), False)
