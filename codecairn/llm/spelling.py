"""Spelling variant grouping: PartEnum signatures over letter multisets.

Words one edit apart differ in at most two elements of their letter multisets,
seen as sets of (letter, occurrence).  The elements are dealt to ``PARTS``
partitions.  Two words of one length differ in at most two partitions, so they
agree on some pair of them: each pair of partitions gives a signature.  Words
whose lengths differ by one differ in one element, so they agree on one half of
the partitions.  A single edit also leaves either the front or the back half of
the shorter word in place; each signature is made with both, which keeps groups
of equal signatures small without losing a pair.  Equal signatures meet in an
equi-join, and every candidate is verified by its edit distance.

The form of a word is its most frequent near word, if that is ``RATIO`` times as
frequent.  Counts grow by that factor at each step, so chains of forms are short
and a few pointer-jumping rounds find their ends.

Defined results: a null text has no words; a null id counts as an empty string in
the rule that drops letters; repeated rows are counted each; an empty table gives
an empty result.  Only the id and text columns are read, so clashing names do no
harm.  A text of any length is one row of runs, a word of any length is treated
alike.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm.common import shared_table, ship, table

#: Shortest word, in code points, and fewest occurrences of a word.
MIN_LENGTH, MIN_COUNT = 7, 2
#: How much more frequent a form is than the word.
RATIO = 10
#: A run loses a letter if this divides its hash.
DROP_EVERY = 31
#: Partitions of the letter elements.
PARTS = 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Sides of a signature: both words of one length, the shorter, the longer word.
SAME, SHORTER, LONGER = 0, 1, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: runs of letters, some with a letter dropped, and their occurrences."""
    folded = F.translate(F.col(text_col).cast("string"), _UPPER, _UPPER.lower())
    # a shorter run cannot leave a word that is long enough
    runs = F.regexp_extract_all(folded, F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), F.col("at")), F.expr("substring(run, at + 2)"))
    word = F.when(F.pmod("h", F.lit(DROP_EVERY)) == 0, dropped).otherwise(F.col("run"))
    return (
        each.withColumn("h", h)
        .withColumn("at", at)
        .select(word.alias("word"))
        .where(F.length("word") >= MIN_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_COUNT)
    )


def parts_of(word: str) -> list[str]:
    """The letter multiset of a word, dealt to partitions, each written in order."""
    seen: dict[str, int] = {}
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        element = f"{c}{seen[c]}"
        parts[zlib.crc32(element.encode()) % PARTS].append(element)
    return [" ".join(sorted(p)) for p in parts]


def _hash(*what: object) -> int:
    return xxhash.xxh64_intdigest("\t".join(map(str, what))) - (1 << 63)


def signatures(word: str) -> list[tuple[int, int]]:
    """``(side, signature)``; any two words one edit apart share one on fitting sides."""
    parts, n = parts_of(word), len(word)
    out = []
    for i, j in combinations(range(PARTS), PARTS - 2):
        for half in (("front", word[: n // 2]), ("back", word[n // 2 :])):
            out.append((SAME, _hash(SAME, n, i, j, parts[i], parts[j], *half)))
    for side, m in ((SHORTER, n), (LONGER, n - 1)):  # m: length of the shorter word
        h = m // 2
        for i in (0, PARTS // 2):
            agreed = parts[i : i + PARTS // 2]
            for half in (("front", word[:h]), ("back", word[n - (m - h) :])):
                out.append((side, _hash(SHORTER, m, i, *agreed, *half)))
    return out


def _signed(words: DataFrame) -> DataFrame:
    """One row per word and signature."""

    @F.pandas_udf("array<struct<side:int,signature:bigint>>")
    def sign(word: pd.Series) -> pd.Series:
        return word.map(lambda w: [{"side": s, "signature": k} for s, k in signatures(w)])

    return words.select("word", "n", F.explode(sign("word")).alias("s")).select("word", "n", "s.*")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every ordered pair of words one edit apart."""
    ship(words.sparkSession)
    signed = shared_table(_signed(words), "spelling-signatures")
    a = signed.where(F.col("side") != LONGER).withColumnsRenamed({"word": "a", "n": "a_n", "side": "a_side"})
    b = signed.where(F.col("side") != SHORTER).withColumnsRenamed({"word": "b", "n": "b_n", "side": "b_side"})
    met = a.join(
        b.withColumnRenamed("signature", "signature_b"),
        (F.col("signature") == F.col("signature_b")) & ((F.col("a_side") == SHORTER) | (F.col("a") < F.col("b"))),
    )
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )
    )
    return pairs.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the ends of chains of forms, by pointer jumping."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("mid"), F.col("root").alias("next"))
        jumped = roots.join(step, F.col("root") == F.col("mid"), "left")
        jumped = shared_table(
            jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Words with their near words counted, their form and the root of its chain.

    ``words`` has distinct ``word`` and their count ``n``.
    """
    near = near_words(words)
    best = near.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("top"),
    )
    enough = -F.col("top.less") >= ratio * F.col("n")
    best = shared_table(
        best.select(
            F.col("word").alias("near_word"),
            "n_near",
            F.when(enough, F.col("top.form")).alias("form"),
            F.when(enough, -F.col("top.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(best.where(F.col("form").isNotNull()).select(F.col("near_word").alias("word"), "form"))
    return (
        words.join(best, F.col("word") == F.col("near_word"), "left")
        .join(roots.withColumnRenamed("word", "rooted"), F.col("word") == F.col("rooted"), "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form_n",
        )
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(shared_table(word_counts(table(spark, sf_dir, "documents")), "spelling-words"))
