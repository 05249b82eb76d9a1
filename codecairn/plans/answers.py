"""The answer loop: requests, attempts at them, and what became of each.

Every attempt leaves one row: its request, the run, the number of the attempt,
its state, and the answer or the error.  Rows are written before they are used,
so no later step asks twice and a run that dies goes on where it stopped.  A
request that fails is tried again, at most ``ATTEMPTS`` times in a run; failures
stay with their request and fail nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.session import materialize
from codecairn.sources.generators import Generator, generate, make_generator

ATTEMPTS = 3
ANSWERED, FAILED = "answered", "failed"
SCHEMA = "prompt_hash string, run string, attempt int, state string, response string, error string"


class GenerationFailed(RuntimeError):
    """Requests that a step cannot go on without have no answer."""


def request_hash(model: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.col("max_tokens").cast("string"), "prompt"), 256)


class Answers:
    """Attempts at requests, below one folder."""

    def __init__(self, spark: SparkSession, folder: str, model: str, run: str, factory: Callable[[str], Generator] = make_generator):
        self.spark, self.folder, self.model, self.run, self.factory = spark, folder, model, run, factory

    def attempts(self) -> DataFrame:
        """All attempts so far; none if nothing was ever asked."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def ask(self, prompts: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
        """``(keys…, prompt, max_tokens)`` to ``(keys…, state, attempts, response, error)``.

        Equal requests are sent once, and one that was ever answered is not sent
        again unless ``force`` asks anew.  ``attempts`` counts those of this run,
        or is 0 where a stored answer served.  Hashes alone meet the stored
        attempts; prompts move only to be sent.
        """
        asked = materialize(prompts.withColumn("prompt_hash", request_hash(self.model)))
        pending = asked.select("prompt_hash").distinct()
        if not force:
            pending = pending.join(self._answered().select("prompt_hash"), "prompt_hash", "left_anti")
        pending = materialize(pending)
        for attempt in range(1, ATTEMPTS + 1):
            if pending.isEmpty():
                break
            wanted = asked.join(pending, "prompt_hash", "left_semi").dropDuplicates(["prompt_hash"])
            done = generate(wanted, self.model, self.factory)
            done.select(
                "prompt_hash", F.lit(self.run).alias("run"), F.lit(attempt).alias("attempt"),
                F.when(F.col("error").isNull(), ANSWERED).otherwise(FAILED).alias("state"), "response", "error",
            ).write.mode("append").parquet(self.folder)
            mine = self.attempts().where((F.col("run") == self.run) & (F.col("attempt") == attempt) & (F.col("state") == FAILED))
            pending = materialize(pending.join(mine.select("prompt_hash"), "prompt_hash", "left_semi"))
        asked_hashes = asked.select("prompt_hash").distinct()
        known = self.attempts().join(asked_hashes, "prompt_hash", "left_semi")
        last = known.groupBy("prompt_hash").agg(
            # an answer before any failure, then the newest
            F.max_by(F.struct("state", "response", "error"), F.struct(F.col("state") == ANSWERED, "run", "attempt")).alias("last"),
            F.coalesce(F.max(F.when(F.col("run") == self.run, F.col("attempt"))), F.lit(0)).alias("attempts"),
        )
        return asked.select(*keys, "prompt_hash").join(last, "prompt_hash").select(
            *keys, "last.state", "attempts", "last.response", "last.error"
        )

    def _answered(self) -> DataFrame:
        return self.attempts().where(F.col("state") == ANSWERED)
