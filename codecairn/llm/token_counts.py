"""Token counts: an exact length histogram and its suffix sums.

Documents are aggregated by encoded length.  One row per length that occurs then
answers, with suffix sums, for a context limit equal to that length: how many
documents and tokens are at least as long, how many tokens stay when every
document is cut at the limit, and the share of documents up to it (quantiles).
Suffix sums run inside buckets of ``BUCKET`` lengths and over bucket totals, so
no task holds the whole histogram.

Defined results: a null or empty text has length 0; repeated rows count each; an
empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecairn.llm.common import encoder, shared_table, ship, table, vocabulary, whole_text

VOCABULARY = "byte_bpe_50k.json"
BUCKET = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, space_led=True)
        for batch in batches:
            counts = [len(ids) // 4 for ids in words.ids(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(counts, type=pa.int64())], names=["length"])

    return run


def token_lengths(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    ship(docs.sparkSession)
    path = vocabulary_path or vocabulary(VOCABULARY)
    return docs.select(whole_text(text_col).alias("text")).mapInArrow(_lengths(path), "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``length, n_docs, n_tokens`` and the suffix sums for a limit of that length."""
    counts = shared_table(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "token-lengths")
    rows = counts.select(
        "length",
        "n_docs",
        (F.col("length") * F.col("n_docs")).alias("n_tokens"),
        F.floor(F.col("length") / BUCKET).alias("bucket"),
    )
    # one row per bucket; their number grows with the longest document only
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    return (
        rows.join(buckets, "bucket")
        .withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("docs_after"))
        .withColumn("tokens_at_least", F.sum("n_tokens").over(inside) + F.col("tokens_after"))
        .select(
            "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
            totals.select("all_docs").scalar().alias("total_docs"),
            totals.select("all_tokens").scalar().alias("total_tokens"),
        )
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length"))
        .withColumn(
            "quantile",
            (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs"),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row: for each limit, tokens that stay when documents are cut there.

    The suffix sums of the shortest length not below the limit answer it.
    """
    sums = F.struct("docs_at_least", "tokens_at_least", "total_tokens")
    found = histogram.agg(
        F.coalesce(F.max("total_tokens"), F.lit(0)).alias("all"),
        *(F.min_by(sums, F.when(F.col("length") >= limit, F.col("length"))).alias(f"s{k}") for k, limit in enumerate(limits)),
    )
    return found.select(
        *(
            F.when(F.col(f"s{k}").isNull(), F.col("all"))
            .otherwise(F.col(f"s{k}.total_tokens") - F.col(f"s{k}.tokens_at_least") + F.col(f"s{k}.docs_at_least") * limit)
            .alias(f"limit_{limit}")
            for k, limit in enumerate(limits)
        )
    )


def quantile_lengths(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """The smallest length up to which at least the given share of documents lies."""
    return histogram.agg(
        *(F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias(f"q{k}") for k, q in enumerate(quantiles))
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
