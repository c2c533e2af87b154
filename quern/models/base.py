"""Models behind the semantic operators, their registry and their prices.

A model answers a prompt for every row of a DataFrame by adding a column. Models whose
answers are Spark expressions run inside the JVM; remote ones run in batches of Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.prompts import Prompt


@dataclass(frozen=True)
class ModelSpec:
    """What the planner knows of a model: price per million tokens, quality, and modalities."""

    name: str
    text_price: float = 0.0
    audio_price: float = 0.0
    output_price: float = 0.0
    quality: float = 1.0
    modalities: tuple[str, ...] = ("text",)
    effort: str | None = None


class Model:
    """Adds the answer to a prompt as a column."""

    spec = ModelSpec("none")

    def answer(self, df: DataFrame, prompt: Prompt, name: str, dtype: str = "string") -> DataFrame:
        raise NotImplementedError


@dataclass
class ExpressionModel(Model):
    """Answers are expressions over the row, by prompt.

    With expressions over hidden label columns it gives the gold answers; with patterns,
    keywords or thresholds over visible columns it is a rule model. An answer is a Column,
    a SQL expression, or a function of the prompt's columns in order; functions and SQL
    can be written down before there is a session.
    """

    answers: Mapping[str, Column | str | Callable[..., Column]] = field(default_factory=dict)
    spec: ModelSpec = ModelSpec("expressions")

    def expression(self, prompt: Prompt, written: Prompt | None = None) -> Column:
        """The answer to a prompt; ``written`` is its text before a join renamed its columns."""
        for text, value in self.answers.items():
            if Prompt(text).key == (written or prompt).key:
                if isinstance(value, str):
                    return F.expr(value)
                return value(*[F.col(c) for c, _ in prompt.slots]) if callable(value) and not isinstance(value, Column) else value
        raise KeyError(f"{self.spec.name} has no answer to: {(written or prompt).text}")

    def answer(self, df: DataFrame, prompt: Prompt, name: str, dtype: str = "string") -> DataFrame:
        return df.withColumn(name, self.expression(prompt).cast(dtype))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two ARRAY<FLOAT> of one length; null if either is null or all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


@dataclass
class EmbeddingModel(Model):
    """Answers a yes-or-no prompt over two vector columns by a threshold on their cosine, any other by the cosine."""

    threshold: float = 0.5
    spec: ModelSpec = ModelSpec("embedding")

    def answer(self, df: DataFrame, prompt: Prompt, name: str, dtype: str = "boolean") -> DataFrame:
        a, b = (F.col(c) for c, _ in prompt.slots[:2])
        score = cosine(a, b)
        return df.withColumn(name, score >= self.threshold if dtype == "boolean" else score.cast(dtype))


class ModelRegistry:
    """Models and prompts by name."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}
        self.prompts: dict[str, Prompt] = {}

    def create_model(self, name: str, model: Model) -> Model:
        self.models[name] = model
        return model

    def create_prompt(self, name: str, text: str) -> Prompt:
        self.prompts[name] = Prompt(text)
        return self.prompts[name]

    def choose(self, policy: str = "max_quality", modality: str = "text") -> Model:
        """The best model ('max_quality') or the cheapest ('min_cost') for a modality; ties go by name."""
        able = [(n, m) for n, m in sorted(self.models.items()) if modality in m.spec.modalities]
        if not able:
            raise LookupError(f"no model for {modality}")
        price = lambda s: s.text_price + s.output_price
        key = {"max_quality": lambda x: (-x[1].spec.quality, price(x[1].spec)), "min_cost": lambda x: (price(x[1].spec), -x[1].spec.quality)}[policy]
        return min(able, key=key)[1]

    def prices(self, spark: SparkSession) -> DataFrame:
        """(model, text, audio, output): USD per million tokens."""
        rows = [(n, float(m.spec.text_price), float(m.spec.audio_price), float(m.spec.output_price)) for n, m in sorted(self.models.items())]
        return spark.createDataFrame(rows, "model string, text double, audio double, output double")
