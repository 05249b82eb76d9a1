"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Every word and every pair of neighbouring words of a text is hashed into one of
``BUCKETS`` buckets.  Two multinomials over the buckets are estimated, one from
trusted documents and one from the whole corpus; a document's score is the sum
of ``log(trusted / corpus)`` over its n-grams, divided by their number plus a
small prior.  It is
kept when the base rule holds and the score is at least ``THRESHOLD``: the same
verdict for the same text and corpus, no sampling.  DataFrame functions only.
All trusted documents count; they are found by a semi join on their ids, before
which a Bloom filter of those ids is tested while the texts are scanned: only
labelled texts, and few others, are shuffled.

Defined results: a null text has no words; a text without words scores 0 and
fails the base rule; an empty corpus, or one without trusted documents, gives
every text score 0.  Rows are judged one by one, so repeated rows and ids do no
harm, and other columns are not read.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm.common import BLANK, table, whole_text

BUCKETS = 1 << 16
#: Added to every bucket of both multinomials, the corpus counts being scaled to the
#: trusted total first: n-grams that are rare in the corpus stay neutral.
SMOOTHING = 8.0
#: Mean log ratio below which a document is dropped.
THRESHOLD = -0.125
#: Neutral n-grams added to every text, so that a few rare words in a short text decide nothing.
LENGTH_PRIOR = 20
WINDOW = 5
#: Trusted ids to a word of 64 filter bits.
IDS_PER_BLOCK = 6
#: The filter is broadcast and has at most so many words (64 MB); with more ids than they
#: can tell apart, more texts than needed are shuffled.
MOST_BLOCKS = 1 << 22


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _ngrams(words: str) -> Column:
    """Bucket of each word, then of each pair."""
    one = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))
    two = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.pmod(F.hash(w, F.get(words, i + 1)), F.lit(BUCKETS)),
    )
    return F.concat(one, two)


def _place(id_: Column, blocks: int) -> tuple[Column, Column]:
    """Block of an id in the filter, and its three bits there."""
    h = F.xxhash64(id_.cast("string"))
    one = F.lit(1).cast("long")
    bits = [
        F.call_function("shiftleft", one, F.shiftrightunsigned(h, step).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        for step in (0, 6, 12)
    ]
    return F.pmod(F.shiftrightunsigned(h, 18), F.lit(blocks).cast("long")), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the trusted documents."""
    same = docs.schema["doc_id"].dataType
    ids = trusted.select(F.col("doc_id").cast(same).alias("trusted_id")).where("trusted_id is not null")
    blocks = min(MOST_BLOCKS, max(1, -(-ids.count() // IDS_PER_BLOCK)))
    block, bits = _place(F.col("trusted_id"), blocks)
    words = ids.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    block, bits = _place(F.col("doc_id"), blocks)
    maybe = docs.select("doc_id", "text").join(
        F.broadcast(words), (F.col("block") == block) & (F.col("bits").bitwiseAND(bits) == bits), "left_semi"
    )
    # merge: the same plan at every size
    return maybe.join(ids.distinct().hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: ``weights``, the log ratio by bucket."""
    labelled = trusted_rows(docs, trusted)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        buckets = rows.select(words_of(F.col("text")).alias("words")).select(F.explode(_ngrams("words")).alias("bucket"))
        return buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    counts = counted(docs, "raw").join(counted(labelled, "trusted"), "bucket", "left")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    ordered = (
        every.join(counts, "bucket", "left")
        .groupBy()
        .agg(
            F.array_sort(
                F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("trusted", F.lit(0)).alias("trusted")))
            ).alias("rows"),
            F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_total"),
            F.coalesce(F.sum("trusted"), F.lit(0)).alias("trusted_total"),
        )
    )
    share = F.col("trusted_total") / F.col("raw_total")
    return ordered.select(
        F.when(F.col("trusted_total") == 0, F.array_repeat(F.lit(0.0), BUCKETS))
        .otherwise(F.transform("rows", lambda r: F.log((r.trusted + SMOOTHING) / (r.raw * share + SMOOTHING))))
        .alias("weights")
    )


def _window_hashes(hashes: str) -> Column:
    """One hash per window of five words, from the hashes of the words."""
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))),
    )


def _covered(windows: str) -> Column:
    """Words inside windows that occur at least twice.  Sorting, so n log n in the text."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_pairs: Column) -> Column:
        same = lambda x, other: F.coalesce(other.h == x.h, F.lit(False))
        marked = F.transform(
            sorted_pairs,
            lambda x, k: F.when(
                same(x, F.get(sorted_pairs, k + 1)) | ((k > 0) & same(x, F.get(sorted_pairs, k - 1))), x.i
            ),
        )
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def reach(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda acc, n: acc + n,
        )

    # one-element arrays name a value that is used many times
    starts = F.transform(F.array(pairs), repeated)
    return F.get(F.transform(starts, reach), 0)


def _pinned(value: Column) -> Column:
    """The value, computed once per row whatever is filtered later.

    The optimizer would write a filter on it anew below the steps that prepare
    it, with the word array spelled out inside every function over words; it
    does not do so with values it must take for non-deterministic.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` as ``row`` (a struct) with counts, ``score`` and verdict.

    ``trusted``: a ``doc_id`` column naming the documents of the target.
    """
    texts = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    weights = bucket_weights(texts, trusted).scalar()
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    read = texts.select(
        "row",
        "doc_id",
        words_of(text).alias("words"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        weights.alias("weights"),
    )
    worded = read.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        }
    )
    hashed = worded.select(
        "row", "doc_id", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes("hashes").alias("windows"),
        F.aggregate(_ngrams("words"), F.lit(0.0), lambda acc, b: acc + F.get("weights", b)).alias("total"),
    )
    counted = hashed.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _pinned(
            F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered("windows")).otherwise(
                F.lit(0).cast("long")
            )
        ).alias("n_repeat_words"),
        _pinned(
            F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(
                F.col("total") / (2 * F.col("n_words") - 1 + LENGTH_PRIOR)
            )
        ).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.round("score", 9) >= threshold))


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, trusted_documents(table(spark, sf_dir, "labels"))).drop("row")
