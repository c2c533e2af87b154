"""A model reached over a network, called in batches from the executors.

Equal prompts are asked once, answers are kept in a table, tokens are returned as columns
(an accumulator would count retried tasks twice), and a failed call is tried again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.prompts import Prompt, parse_boolean, to_number
from quern.models.base import Model, ModelSpec
from quern.staging import existing, stage

#: A client takes a prompt and gives (answer, input tokens, output tokens).
Client = Callable[[str], tuple[str, int, int]]


@dataclass
class RemoteModel(Model):
    client: Client
    spec: ModelSpec = ModelSpec("remote")
    workers: int = 20
    batch: int = 20
    attempts: int = 3
    pause: float = 0.2
    cache: str | None = None

    def _ask(self, prompt: str) -> tuple[str | None, int, int, str | None]:
        for k in range(self.attempts):
            try:
                return (*self.client(prompt), None)
            except Exception as e:  # any failure of the service is tried again, then told
                error = f"{type(e).__name__}: {e}"
                if k + 1 < self.attempts:
                    time.sleep(self.pause * 2**k)
        return None, 0, 0, error

    def complete(self, prompts: DataFrame) -> DataFrame:
        """(prompt, answer, in_tokens, out_tokens, error) for a table of distinct prompts."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(self.workers) as pool:
                for pdf in batches:
                    for k in range(0, len(pdf), self.workers * self.batch):
                        part = pdf["prompt"].iloc[k : k + self.workers * self.batch]
                        rows = [(p, *r) for p, r in zip(part, pool.map(self._ask, part))]
                        yield pd.DataFrame(rows, columns=["prompt", "answer", "in_tokens", "out_tokens", "error"])

        return prompts.mapInPandas(run, "prompt string, answer string, in_tokens long, out_tokens long, error string")

    def answers(self, prompts: DataFrame) -> DataFrame:
        """As ``complete``, but prompts in the cache table are taken from it and new answers are added to it."""
        if not self.cache:
            return stage(self.complete(prompts), "answers")
        spark = prompts.sparkSession
        kept = existing(spark, self.cache)
        if kept is None:
            return self._keep(stage(self.complete(prompts), "answers"))
        kept = kept.filter(F.col("model") == self.spec.name).drop("model")
        fresh = stage(self.complete(prompts.join(kept, "prompt", "left_anti")), "answers")
        known = stage(prompts.join(kept, "prompt").withColumns({"in_tokens": F.lit(0).cast("long"), "out_tokens": F.lit(0).cast("long"), "error": F.lit(None).cast("string")}), "known")
        return known.select(fresh.columns).unionByName(self._keep(fresh))

    def _keep(self, fresh: DataFrame) -> DataFrame:
        fresh.filter(F.col("error").isNull()).select("prompt", "answer", F.lit(self.spec.name).alias("model")).write.mode("append").parquet(self.cache)
        return fresh

    def answer(self, df: DataFrame, prompt: Prompt, name: str, dtype: str = "string") -> DataFrame:
        """``df`` with the answer as ``name`` and ``name_usage`` struct<in_tokens, out_tokens, model>; null prompts have null answers."""
        asked = df.withColumn("_prompt", prompt.render())
        said = self.answers(asked.select(F.col("_prompt").alias("prompt")).filter(F.col("prompt").isNotNull()).distinct())
        value = {"boolean": parse_boolean, "double": to_number}.get(dtype, lambda c: c.cast(dtype))(F.col("answer"))
        usage = F.struct("in_tokens", "out_tokens", F.lit(self.spec.name).alias("model"))
        both = asked.join(said, F.col("_prompt") == F.col("prompt"), "left")
        return both.select(*[df[c] for c in df.columns], value.alias(name), usage.alias(f"{name}_usage"))

    def first_true(self, df: DataFrame, prompt: Prompt, n: int) -> DataFrame:
        """Any ``n`` rows for which the prompt is true, asking little beyond them.

        Each partition stops asking once it has ``n`` rows; a plain filter under a limit
        would ask for whole partitions.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = 0
            with ThreadPoolExecutor(self.workers) as pool:
                for pdf in batches:
                    for k in range(0, len(pdf), max(self.workers, n)):
                        part = pdf.iloc[k : k + max(self.workers, n)]
                        said = pool.map(lambda p: self._ask(p)[0] if isinstance(p, str) else None, part["_prompt"])
                        hits = part[[str(a).strip().lower() in ("true", "yes") for a in said]].drop(columns="_prompt")
                        found += len(hits)
                        yield hits
                        if found >= n:
                            return

        asked = df.withColumn("_prompt", prompt.render())
        return asked.mapInPandas(run, df.schema).limit(n)
