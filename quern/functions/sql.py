"""Semantic functions in SQL text.

``sem_sql`` runs a statement in which AI_IF, AI_JOIN, AI_MAP, AI_CLASSIFY, AI_SCORE and
AI_REDUCE take a prompt as their first argument; AI_JOIN stands in the condition of a join,
AI_REDUCE for an aggregate, and AI_CLASSIFY may name its labels in a last ARRAY(...). For models that are expressions each call is replaced by its
expression before Spark parses the statement, so the plan has no Python in it; other
models are registered as vectorised functions by ``register``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CALL = re.compile(
    r"\bAI_(IF|JOIN|MAP|CLASSIFY|SCORE|REDUCE)\s*\(\s*'((?:[^']|'')*)'\s*((?:,\s*(?!ARRAY\b)[\w.`]+\s*)*)(?:,\s*ARRAY\s*\(((?:[^()']|'(?:[^']|'')*')*)\)\s*)?\)", re.IGNORECASE
)


def expand(text: str, answers: Mapping[str, str]) -> str:
    """The statement with every semantic call replaced by its SQL expression.

    ``answers`` gives an expression per prompt, with $1, $2 and so on for the arguments.
    """
    known = {re.sub(r"\s+", " ", k).strip().lower(): v for k, v in answers.items()}

    def one(m: re.Match) -> str:
        key = re.sub(r"\s+", " ", m[2].replace("''", "'")).strip().lower()
        if key not in known:
            raise KeyError(f"no answer to: {m[2]}")
        arguments = [a.strip() for a in m[3].split(",") if a.strip()]
        out = re.sub(r"\$(\d+)", lambda x: arguments[int(x[1]) - 1], known[key])
        if m[4] is not None:
            return f"(CASE WHEN ({out}) IN ({m[4]}) THEN ({out}) END)"
        return f"try_cast(({out}) AS DOUBLE)" if m[1].upper() == "SCORE" else f"({out})"

    return _CALL.sub(one, text)


def sem_sql(spark: SparkSession, text: str, answers: Mapping[str, str], variables: Mapping[str, str] | None = None, **parameters: object) -> DataFrame:
    """Run a statement with semantic calls; <<name>> is replaced by a variable, :name bound as a parameter."""
    for name, value in (variables or {}).items():
        text = text.replace(f"<<{name}>>", value)
    return spark.sql(expand(text, answers), args=parameters or None)


def register(spark: SparkSession, client) -> None:
    """Register ai_if, ai_generate, ai_score, ai_classify and ai_reduce as vectorised functions over a finished prompt string.

    ai_classify also takes the labels as an array, ai_reduce the rows' texts as one, as of
    collect_list over groups of bounded size; both ask each distinct question of a batch once.
    """

    @F.pandas_udf("string")
    def ai_generate(prompt: pd.Series) -> pd.Series:
        seen = {p: client(p)[0] for p in prompt.dropna().unique()}
        return prompt.map(seen)

    @F.pandas_udf("boolean")
    def ai_if(prompt: pd.Series) -> pd.Series:
        seen = {p: str(client(p)[0]).strip().lower() for p in prompt.dropna().unique()}
        return prompt.map(lambda p: {"true": True, "yes": True, "false": False, "no": False}.get(seen.get(p)))

    @F.pandas_udf("double")
    def ai_score(prompt: pd.Series) -> pd.Series:
        seen = {p: pd.to_numeric(client(p)[0], errors="coerce") for p in prompt.dropna().unique()}
        return prompt.map(seen).astype("float64")

    @F.pandas_udf("string")
    def ai_classify(prompt: pd.Series, labels: pd.Series) -> pd.Series:
        asked = [None if not isinstance(p, str) or ls is None else (p, tuple(ls)) for p, ls in zip(prompt, labels)]
        seen = {a: str(client("\n".join([a[0], "Answer with one of these labels only:", *a[1]]))[0]).strip() for a in set(asked) - {None}}
        return pd.Series([seen[a] if a is not None and seen[a] in a[1] else None for a in asked], dtype=object)

    @F.pandas_udf("string")
    def ai_reduce(prompt: pd.Series, texts: pd.Series) -> pd.Series:
        asked = [None if not isinstance(p, str) or ts is None else "\n".join([p, *[t for t in ts if t is not None]]) for p, ts in zip(prompt, texts)]
        seen = {a: client(a)[0] for a in set(asked) - {None}}
        return pd.Series([seen.get(a) for a in asked], dtype=object)

    for name, f in (("ai_generate", ai_generate), ("ai_if", ai_if), ("ai_score", ai_score), ("ai_classify", ai_classify), ("ai_reduce", ai_reduce)):
        spark.udf.register(name, f)
