"""Texts of any size reduced to a bounded one, level by level.

Parts of a key are laid in order into batches of at most ``limit`` characters.
A key that fits into one batch is its text as it stands: a small project is the
one-level case.  Otherwise every batch is summarized by the provider, and the
summaries are the parts of the next level.  Each prompt and each gathered text
is bounded by ``limit``, whatever the project's size; only ordering keys and
lengths are compared across a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecairn.functions.text import path_key
from codecairn.operators import budgets, prompts
from codecairn.session import materialize

#: Characters of one batch, and of a finished digest.
DIGEST_CHARS = 400_000
#: Answer length of one summary, in tokens.
SUMMARY_TOKENS = 4096


def _short_parts(parts: DataFrame, limit: int) -> DataFrame:
    """Parts of at most ``limit`` characters; a longer one is split, none is cut."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(limit))
    return parts.select("key", "path", "text", F.posexplode(starts).alias("piece", "at")).select(
        "key",
        # numbers of one width keep the order of pieces under the order of paths
        F.concat("path", F.lit("/"), F.lpad(F.col("piece").cast("string"), 9, "0")).alias("path"),
        F.substring(F.col("text"), F.col("at") + 1, F.lit(limit)).alias("text"),
    )


def digests(store, parts: DataFrame, subject: Column, project: str, model: str, force: bool, limit: int | None = None) -> DataFrame:
    """``(key, path, text)`` to ``(key, text)``, each text within the limit.

    ``subject`` names what a key's text is, for the summary prompts.
    """
    limit = limit or DIGEST_CHARS
    finished, left = None, None
    while True:
        parts = materialize(_short_parts(parts, limit))
        sizes = parts.select(F.col("key").alias("dir"), "path", F.length("text").alias("n_chars"))
        placed = budgets.module_batches(sizes, limit).select(F.col("dir").alias("key"), "path", "batch")
        rows = F.array_sort(F.collect_list(F.struct(path_key(F.col("path")).alias("k"), "text")))  # one batch: at most the limit
        batches = materialize(
            parts.join(placed, ["key", "path"])
            .groupBy("key", "batch")
            .agg(F.array_join(F.transform(rows, lambda r: r.text), "\n").alias("text"))
        )
        last = batches.groupBy("key").agg(F.max("batch").alias("last"))
        fits = batches.join(last.where("last = 0"), "key").select("key", "text")
        finished = fits if finished is None else finished.unionByName(fits)
        more = batches.join(last.where("last > 0"), "key")
        n = more.count()
        if n == 0:
            return finished
        if left is not None and n >= left:
            raise ValueError("summaries are not shorter than what they summarize")
        left = n
        asked = prompts.digest_prompts(more, subject, project).withColumn("max_tokens", F.lit(SUMMARY_TOKENS))
        answers = store.answer(asked, ["key", "batch"], model, force)
        parts = answers.select(
            "key", F.lpad(F.col("batch").cast("string"), 12, "0").alias("path"), F.col("response").alias("text")
        )


def digest(store, parts: DataFrame, subject: str, project: str, model: str, force: bool, limit: int | None = None) -> str:
    """One text for all parts ``(path, text)``; bounded, so it may come to the driver."""
    keyed = parts.select(F.lit("").alias("key"), "path", "text")
    row = digests(store, keyed, F.lit(subject), project, model, force, limit).first()
    return row.text if row else ""
