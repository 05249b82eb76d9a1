"""Exact top-k cosine search over one or two indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecairn.functions.vectors import cosine_to

# Which index answers which selector.
SELECTORS = {"all": ("docs", "code"), "docs": ("docs",), "code": ("code",)}

# Fixed value: decimals of a shown score.
SCORE_DECIMALS = 4

#: Decimals that ranking sees: all that do not depend on the order of a sum.
RANK_DECIMALS = 12


def top_k(
    vectors: DataFrame,
    query: Sequence[float],
    k: int,
    key: Sequence[str],
    vector: str = "embedding",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` best rows by score, ties by ``key``; rows without a vector have no score.

    Only the key, the vector and ``keep`` are read; each task keeps a heap of
    ``k`` rows, so what is merged at the end is ``k`` rows per task.  Keep
    other columns only where they are computed along with the vector; over a
    stored index fetch them for the hits alone (:func:`key_filter`).  Scores
    stay exact for merging; :func:`shown` rounds them for display.
    """
    score = F.round(cosine_to(F.col(vector), query), RANK_DECIMALS)
    return (
        vectors.where(F.col(vector).isNotNull())
        .select(*key, *keep, score.alias("score"))
        .orderBy(F.desc("score"), *key)
        .limit(k)
    )


def merge_top_k(
    docs: DataFrame | None, code: DataFrame | None, k: int, key: Sequence[str]
) -> DataFrame:
    """Merge two per-index top-k results; the docs index wins ties."""
    sides = [
        side.withColumn("side", F.lit(rank))
        for rank, side in enumerate((docs, code))
        if side is not None
    ]
    merged = sides[0]
    for side in sides[1:]:
        merged = merged.unionByName(side)
    return merged.orderBy(F.desc("score"), "side", *key).limit(k)


def search_vectors(
    docs: DataFrame | None,
    code: DataFrame | None,
    query_docs: Sequence[float] | None,
    query_code: Sequence[float] | None,
    k: int,
    key: Sequence[str],
    source: str = "all",
) -> DataFrame:
    """Search the selected indexes.

    ``docs`` and ``all`` need the docs index; a missing code index gives no
    rows under ``code`` and is left out under ``all``.
    """
    if source not in SELECTORS:
        raise ValueError(f"source must be one of {sorted(SELECTORS)}")
    wanted = SELECTORS[source]
    if "docs" in wanted and docs is None:
        raise FileNotFoundError("docs index not found; build it first")
    left = top_k(docs, query_docs, k, key) if "docs" in wanted else None
    right = top_k(code, query_code, k, key) if "code" in wanted and code is not None else None
    if left is None and right is None:
        return docs.select(*key, F.lit(0.0).alias("score"), F.lit(0).alias("side")).limit(0)
    return merge_top_k(left, right, k, key)


def shown(hits: DataFrame) -> DataFrame:
    """Hits with their scores rounded for display, after all ranking."""
    return hits.withColumn("score", F.round("score", SCORE_DECIMALS))


def key_filter(keys: Sequence[Sequence], columns: Sequence[str]) -> Column:
    """Pushable predicate selecting the given keys (at most ``k`` of them)."""
    match = F.lit(False)
    for values in keys:
        one = F.lit(True)
        for column, value in zip(columns, values):
            one = one & (F.col(column) == F.lit(value))
        match = match | one
    return match
