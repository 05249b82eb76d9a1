"""Exact dedup: two-pass Bloom filtering, DataFrame functions only.

Pass 1 sets, for each text, three bits in one 64-bit block of a Bloom filter and
counts how often each bit pattern was set; patterns set twice make the second
filter.  Pass 2 tests every text against that filter while it is scanned.  Texts
that fail are unique for certain and pass straight through; only the others
("candidates") are shuffled, by their SHA-256, to be grouped exactly.

Defined results: a null text counts as empty; an empty table gives an empty
result; of equal texts the row with the largest id stays, null ids lose to any
other, and of repeated rows with one id exactly one stays.  Columns other than
the id and the text are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm.common import shared_table, table, whole_text

#: Rows that share one 64-bit block on average: 4 bits of filter per row.
ROWS_PER_BLOCK = 16
#: Blocks of a filter that is still broadcast (16 bytes each as rows).
BROADCAST_BLOCKS = 4_000_000


def _block(text: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(text), 18), F.lit(blocks).cast("long"))


def _mask(text: Column) -> Column:
    h = F.xxhash64(text)
    bits = []
    for step in (0, 6, 12):
        position = F.shiftrightunsigned(h, step).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bits.append(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def repeat_filter(texts: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)`` of the bit patterns that pass 1 set at least twice."""
    text = F.col("text")
    return (
        texts.select(_block(text, blocks).alias("block"), _mask(text).alias("mask"))
        .groupBy("block", "mask")
        .count()
        .where("count > 1")
        .groupBy("block")
        .agg(F.bit_or("mask").alias("bits"))
    )


def _with_flag(texts: DataFrame, n_rows: int) -> DataFrame:
    """Pass 2: adds ``candidate``; false means no other row has the text."""
    blocks = max(1, -(-n_rows // ROWS_PER_BLOCK))
    bits = repeat_filter(texts, blocks)
    if blocks <= BROADCAST_BLOCKS:  # else a shuffled join on the block
        bits = F.broadcast(bits)
    return (
        texts.withColumn("block", _block(F.col("text"), blocks))
        .withColumn("mask", _mask(F.col("text")))
        .join(bits, "block", "left")
        .withColumn("candidate", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
        .drop("block", "mask", "bits")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    narrow = _with_flag(texts, docs.count()).select(
        "doc_id",
        "candidate",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
    )
    marked = shared_table(narrow, "exact-marked")
    candidates = marked.where("candidate")
    groups = shared_table(
        candidates.groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"))
        .where("n > 1"),
        "exact-groups",
    )
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    single = (
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        digest,
    )
    grouped = candidates.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        digest,
    )
    return marked.where("not candidate").select("doc_id", *single).unionAll(grouped)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, whole rows; those the filter clears are never shuffled."""
    whole = F.struct("*").alias("whole")
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), whole)
    flagged = _with_flag(texts, docs.count())
    candidates = flagged.where("candidate").withColumn("sha", F.sha2("text", 256)).drop("text")
    keep = candidates.groupBy("sha").agg(F.max("doc_id").alias("keep_id"))
    kept = (
        candidates.join(keep.withColumnRenamed("sha", "keep_sha"), (F.col("sha") == F.col("keep_sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("sha")
        .agg(F.first("whole").alias("whole"))
    )
    return flagged.where("not candidate").select("whole").unionAll(kept.select("whole")).select("whole.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
