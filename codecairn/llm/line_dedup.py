"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation, so a line in a third of all documents is one small state
per task.  Lines whose estimate is clearly at or above ``MIN_SITES`` are
boilerplate; for those near the threshold sites are counted exactly.  Boilerplate
lines are removed from documents.

A document most of whose text would go is a copy of a page, not a page with
boilerplate on it; it is left as it is, for near-duplicate removal.

The set of boilerplate lines is broadcast when a count shows that it has at most
``BROADCAST_LINES`` hashes; beyond that each document's lines are joined with it
and the hits come back by document.

Defined results: lines are compared without blanks (spaces) at their ends; lines
of fewer than ``MIN_WORDS`` words are never boilerplate; a null text counts as
empty and stays null; a null site is a site of its own; repeated rows are cleaned
alike; an empty table gives an empty result; other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecairn.llm.common import BLANK, shared_table, ship, table, whole_text

MIN_SITES = 10
MIN_WORDS = 4
#: log2 of a sketch's registers; the relative error of an estimate is 1.04 / sqrt(2 ** 9), 4.6 %.
LOG_REGISTERS = 9
#: Estimates within this share of the threshold (over five errors) are counted exactly.
NEAR = 0.25
BROADCAST_LINES = 200_000
#: A document loses lines only if they hold at most this share of its characters.
MOST_REMOVED = 0.5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _hash(line: Column) -> Column:
    return F.xxhash64(line)  # XXH64 of the UTF-8 bytes, seed 42


def _lines(text: Column) -> Column:
    """Trimmed lines that may be boilerplate."""
    # possessive, and from the start only: linear in the line
    enough = rf"^{BLANK}*+(?:[^\x20\x09-\x0D]++{BLANK}++){{{MIN_WORDS - 1}}}[^\x20\x09-\x0D]"
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s.rlike(enough))


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``line``: hashes of lines on at least ``min_sites`` distinct sites."""
    seen = docs.select(
        F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00"))).alias("site"),
        F.explode(_lines(whole_text(text_col))).alias("text"),
    ).select("site", _hash(F.col("text")).alias("line"))
    spread = shared_table(
        seen.groupBy("line")
        .agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR)),
        "line-spread",
    )
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line")
    exact = (
        seen.distinct()
        .join(near, "line", "left_semi")
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line")
    )
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("line")
    return sure.unionAll(exact)


def clean_text(text: str | None, lines: frozenset[int] | set[int]) -> tuple[str | None, int]:
    """The text without boilerplate lines, and how many went."""
    if not text or not lines:
        return text, 0
    kept, gone, total = [], 0, 0
    for line in text.split("\n"):
        bare = line.strip(" ")
        total += len(bare)
        if bare and xxhash.xxh64_intdigest(bare.encode("utf-8"), 42) in lines and len(_WORD.findall(bare)) >= MIN_WORDS:
            gone += len(bare)
        else:
            kept.append(line)
    if not gone or gone > MOST_REMOVED * total:
        return text, 0
    return "\n".join(kept), text.count("\n") + 1 - len(kept)


def _cleaner(common: frozenset[int] | None):
    """``common``: the broadcast hashes; None if each row brings its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = batch.column("hits").to_pylist() if common is None else None
            made = [
                clean_text(t, common if own is None else {h & 0xFFFFFFFFFFFFFFFF for h in own[k] or ()})
                for k, t in enumerate(texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())],
                names=["row", "text", "n_removed"],
            )

    return run


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``row`` (the document as it was), ``text`` (cleaned) and ``n_removed`` lines."""
    ship(docs.sparkSession)
    flagged = shared_table(boilerplate_lines(docs, site_col, text_col, min_sites), "line-boilerplate")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    fields = T.StructType(
        [rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]
    )
    if flagged.count() <= broadcast_lines:
        common = frozenset(r.line & 0xFFFFFFFFFFFFFFFF for r in flagged.collect())
        return rows.mapInArrow(_cleaner(common), fields)
    hits = (
        docs.select(F.col(id_col).alias("id"), F.explode(_lines(whole_text(text_col))).alias("t"))
        .select("id", _hash(F.col("t")).alias("line"))
        .distinct()
        .join(flagged, "line", "left_semi")
        .groupBy("id")
        .agg(F.collect_list("line").alias("hits"))
    )
    joined = rows.join(hits, rows["row"][id_col].eqNullSafe(hits["id"]), "left").select("row", "text", "hits")
    return joined.mapInArrow(_cleaner(None), fields)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split(whole_text("text"), "\n")).cast("long").alias("n_lines"),
        "n_removed",
        F.sha2(whole_text("text"), 256).alias("text_sha256"),
    )


_MAY = r"regexp_matches(x.line, '[^\x20\x09-\x0D](.*?[\x20\x09-\x0D][^\x20\x09-\x0D]){3}', 's')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, coalesce(source, chr(1)) AS source, trim(u.line) AS line
      FROM d, unnest(string_split(text, chr(10))) AS u(line)),
b AS (SELECT line FROM x WHERE {_MAY} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
p AS (SELECT d.doc_id, d.text, u.line, u.pos, trim(u.line) IN (SELECT line FROM b) AS hit
      FROM d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                              generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) AS u),
g AS (SELECT doc_id, any_value(text) AS text, count(*) AS n, count(*) FILTER (hit) AS gone,
             coalesce(sum(length(trim(line))) FILTER (hit), 0) AS gone_chars, sum(length(trim(line))) AS chars,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest
      FROM p GROUP BY doc_id)
SELECT doc_id,
       n - CASE WHEN gone_chars > {MOST_REMOVED} * chars THEN 0 ELSE gone END AS n_lines,
       CASE WHEN gone_chars > {MOST_REMOVED} * chars THEN 0 ELSE gone END AS n_removed,
       sha256(CASE WHEN gone = 0 OR gone_chars > {MOST_REMOVED} * chars THEN text ELSE rest END) AS text_sha256
FROM g
"""
