"""Stored model answers: what a model said to a prompt is kept in a committed table, so that no run asks for it again.

A prompt's key is a hash of model and prompt. `fill` asks for the distinct prompts that have no answer yet and commits what comes; `answered` joins the
stored answers to rows and never calls the model, whatever is recomputed. Only the calls of a task that is lost while it asks are repeated; tasks
are small (`most` prompts), and finished ones have written their answers.

A call that fails is repeated after 1, 2, 4... seconds; after the last time the error is stored in place of the answer, and the next `fill` asks again.
Null prompts are not asked and have no answer; the empty text is a prompt. Repeated prompts are asked once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .readers import with_retry
from .snapshots import Snapshots

SCHEMA = "prompt_key string, model string, answer string, tokens_used long, raw_response string, error string"


def parsed(answer: Callable[[str], str | dict]) -> Callable[[str], dict]:
    """An answer that must be JSON: its text is the answer in one form (ValueError if it is none, so that it is asked for again)."""

    def ask(prompt: str) -> dict:
        got = answer(prompt)
        got = got if isinstance(got, dict) else {"text": got}
        return got | {"text": json.dumps(json.loads(got["text"]), ensure_ascii=False), "raw": got.get("raw", got["text"])}

    return ask


class Answers:
    """Answers of one model. `answer` takes a prompt and gives a text, or a dictionary of text, tokens and raw."""

    def __init__(self, spark: SparkSession, root: str, model: str, buckets: int = 16):
        self.spark, self.model, self.table = spark, model, Snapshots(spark, root, ["prompt_key"], buckets)

    def key(self, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.model + "\0"), prompt).cast("binary"), 256)

    def stored(self) -> DataFrame:
        return self.table.read() if self.table.versions() else self.spark.createDataFrame([], SCHEMA)

    def missing(self, prompts: DataFrame, column: str) -> DataFrame:
        """(prompt_key, prompt) of the distinct prompts without an answer."""
        asked = prompts.select(self.key(F.col(column)).alias("prompt_key"), F.col(column).alias("prompt")).where("prompt is not null").dropDuplicates(["prompt_key"])
        return asked.join(self.stored().where("error is null").select("prompt_key"), "prompt_key", "left_anti")

    def fill(self, prompts: DataFrame, column: str, answer: Callable[[str], str | dict], attempts: int = 3, on: tuple[type[Exception], ...] = (Exception,), wait: Callable[[float], None] = time.sleep, most: int = 64, batch: int | None = None) -> int:
        """Asks for the missing prompts; how many they were. Of errors only those in `on` are tried again and stored; others end the call.

        With `batch`, the model takes up to so many prompts at once as a list and gives a list in their order; one failure is that of all of them.
        """
        left = cut(self.missing(prompts, column))
        n = left.count()
        if not n:
            return 0
        model = self.model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch_rows in batches:
                rows = []
                for i in range(0, len(batch_rows), batch or 1):
                    keys, said = (batch_rows[c].iloc[i : i + (batch or 1)].tolist() for c in ("prompt_key", "prompt"))

                    def call(said=said) -> list:
                        got = answer(said) if batch else [answer(said[0])]
                        if len(got) != len(said):
                            raise ValueError(f"{len(got)} answers to {len(said)} prompts")
                        return got

                    try:
                        got = [g if isinstance(g, dict) else {"text": g} for g in with_retry(call, attempts, wait, on)]
                        rows += [(k, model, g.get("text"), g.get("tokens"), g.get("raw"), None) for k, g in zip(keys, got, strict=True)]
                    except on as e:
                        rows += [(k, model, None, None, None, f"{type(e).__name__}: {e}") for k in keys]
                yield pd.DataFrame(rows, columns=["prompt_key", "model", "answer", "tokens_used", "raw_response", "error"]).astype({"tokens_used": "Int64"})

        dealt = left.withColumn("_n", F.monotonically_increasing_id()).repartition(-(-n // most), "_n").select("prompt_key", "prompt")
        self.table.replace(dealt.mapInPandas(run, SCHEMA))
        return n

    def answered(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Adds the stored answer, its tokens and its error as out, out_tokens and out_error; null where there is none."""
        kept = self.stored().select(F.col("prompt_key").alias("_key"), F.col("answer").alias(out), F.col("tokens_used").alias(f"{out}_tokens"), F.col("error").alias(f"{out}_error"))
        return df.withColumn("_key", self.key(F.col(column))).join(kept, "_key", "left").drop("_key")
