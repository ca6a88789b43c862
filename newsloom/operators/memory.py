"""Answers of a text generator that are kept: equal prompts make one call, and what has been stored is not asked again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.store import Store

ANSWERS = "prompt_key string, response string, error string, tries int"
_TABLE = "answers"


def prompt_key(prompt: Column) -> Column:
    """What answers are kept under: the SHA-256 of the prompt."""
    return F.sha2(prompt.cast("binary"), 256)


@dataclass(frozen=True)
class Remembered:
    """A generator with the store of its answers at ``path``, to be given wherever a generator is taken.

    A prompt is asked at most once, however many rows have it, and never if its answer is in the store. A call that raises an
    error is repeated, ``tries`` times in all; then the prompt is kept as failed, with the error, and not asked again unless
    ``retry_failed``. Prompts are asked ``at_once`` at a time, and each lot is stored before the next begins: a job that dies
    loses one lot of answers at most. Null prompts are not asked. ``tasks`` calls run side by side.
    """

    generate: Callable[[str], str]
    path: str
    tries: int = 3
    at_once: int = 10_000
    tasks: int = 32
    retry_failed: bool = False

    def known(self, spark: SparkSession) -> DataFrame:
        """(prompt_key, response, error, tries) of all prompts that were asked: the answer, or else the last error."""
        kept = Store(spark, self.path).read(_TABLE)
        if kept is None:
            return spark.createDataFrame([], ANSWERS)
        best = F.max(F.struct(F.col("response").isNotNull().alias("good"), "tries", "response", "error"))
        return kept.groupBy("prompt_key").agg(best.alias("x")).select("prompt_key", "x.response", "x.error", "x.tries")

    def ask(self, prompts: DataFrame) -> DataFrame:
        """(prompt_key, response, error, tries) that covers every prompt of (prompt), from the store."""
        spark = prompts.sparkSession
        store, generate, tries = Store(spark, self.path), self.generate, self.tries
        asked = prompts.select("prompt").where("prompt is not null").distinct().withColumn("prompt_key", prompt_key(F.col("prompt")))

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, prompt in zip(batch["prompt_key"], batch["prompt"], strict=True):
                    response = error = None
                    for n in range(1, tries + 1):
                        try:
                            response, error = generate(prompt), None
                            break
                        except Exception as e:  # noqa: BLE001  whatever a generator raises is its failure
                            error = f"{type(e).__name__}: {e}"
                    if response is None and error is None:
                        error = "no answer"
                    rows.append((key, response, error, n))
                yield pd.DataFrame(rows, columns=["prompt_key", "response", "error", "tries"])

        before = self.known(spark)
        if self.retry_failed:
            before = before.where("response is not null")
        todo = asked.join(before.select("prompt_key"), "prompt_key", "left_anti")
        lots = -(-todo.count() // self.at_once)
        lot = F.pmod(F.xxhash64("prompt_key"), F.lit(max(1, lots)))
        for i in range(lots):
            # ``before`` stays what was known when the asking began; one write makes the calls of a lot, and nothing evaluates them again
            store.append(_TABLE, todo.where(lot == i).repartition(self.tasks, "prompt_key").mapInPandas(call, ANSWERS))
        return self.known(spark)
