"""What has to be generated again, by comparing content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_descriptions(files: DataFrame, described: DataFrame, force: bool = False) -> DataFrame:
    """Files without a description of their current hash (anti join on path and hash)."""
    if force:
        return files
    return files.join(described.select("path", "source_hash"), ["path", "source_hash"], "left_anti")


def description_actions(files: DataFrame, described: DataFrame) -> DataFrame:
    """Each file marked ``cached`` or ``generate``."""
    known = described.select("path", "source_hash", F.lit(True).alias("_known"))
    return files.join(known, ["path", "source_hash"], "left").select(
        "path",
        "source_hash",
        F.when(F.col("_known"), F.lit("cached")).otherwise("generate").alias("action"),
    )


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count_if(F.col("action") == "cached").alias("cached"),
        F.count_if(F.col("action") == "generate").alias("generated"),
    )


def article_status(
    stored: DataFrame, current: DataFrame, names: DataFrame, force: bool = False
) -> DataFrame:
    """``(name, stale)`` for every wanted article.

    ``stored`` and ``current`` are ``(name, path, hash)``: the hashes an
    article was made from and those of the sources it should cover now.  An
    article is stale when forced, when nothing is stored for it, or when any
    path was added, removed or changed.  The comparison is keyed by article
    and path, so an article over every file spreads over all tasks; only the
    partial verdicts meet per article.
    """
    compared = (
        stored.select("name", "path", F.col("hash").alias("stored_hash"))
        .join(
            current.select("name", "path", F.col("hash").alias("current_hash")),
            ["name", "path"],
            "full_outer",
        )
        .groupBy("name")
        .agg(
            F.count("stored_hash").alias("n_stored"),
            F.bool_or(~F.col("stored_hash").eqNullSafe(F.col("current_hash"))).alias("differs"),
        )
    )
    stale = (
        F.lit(force)
        | F.col("n_stored").isNull()
        | (F.col("n_stored") == 0)
        | F.coalesce("differs", F.lit(False))
    )
    return names.select("name").join(compared, "name", "left").select("name", stale.alias("stale"))


def any_stale(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.bool_or("stale"), F.lit(False)).alias("any_stale"))
