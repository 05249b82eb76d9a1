"""Ranked lexical search: accumulator-limited term-at-a-time scoring.

The documents are cut into shards.  A first scan leaves, per shard, the postings
of the terms that the queries hold, and the statistics of the whole table.  Each
shard then answers every query term by term, rarest first: a term's postings add
to accumulators and may create new ones until the remaining terms together can
no longer lift an unseen document over the k-th best partial score.  From there
on no accumulator is created, those that can no longer reach that score are let
go, and the others are updated exactly.  The best k of each shard meet in one
ranking.  The queries are a stated set against all rows: they go to the tasks in
blocks of ``BLOCK_BYTES`` of text, each block with scans of its own.

Defined results: a null text, of a document or a query, has no terms; such a
document is not counted and never found, such a query finds nothing.  Every row
is a document of its own, also where ids or whole rows repeat; equal scores are
ranked by ascending id, null ids last.  A query whose terms no document holds
gives no rows, and an empty table on either side gives an empty result.  Only
the id and text columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecairn.llm.common import shared_table, ship, table

#: Documents returned per query.
BEST = 10
#: Bytes of text that make a shard full.
SHARD_BYTES = 8_000_000
#: Bytes of query text held by a task at once.
BLOCK_BYTES = 8_000_000

# A-Z to a-z; ASCII that is no digit or letter to a space; all else stays.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)

_SHARD = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int32())),
        ("places", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int64())),
    ]
)
_SHARD_DDL = (
    "ids array<bigint>, lengths array<bigint>, terms array<int>, starts array<int>, places array<int>, counts array<bigint>"
)
_FOUND = pa.schema(
    [("query", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]
)
_FOUND_DDL = "query int, item_id bigint, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII digits and letters and of all other characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _shard(ids: list, texts: list[bytes], vocabulary: dict[bytes, int]) -> list[list]:
    """Postings of the vocabulary's terms in some documents, by term."""
    lengths, term, place, count = [], [], [], []
    for at, text in enumerate(texts):
        words = terms_of(text)
        lengths.append(len(words))
        found = Counter(words)
        held = vocabulary.keys() & found.keys() if len(found) > len(vocabulary) else [w for w in found if w in vocabulary]
        for w in held:
            term.append(vocabulary[w])
            place.append(at)
            count.append(found[w])
    term = np.array(term, np.int32)
    order = np.argsort(term, kind="stable")
    distinct, starts = np.unique(term[order], return_index=True)
    return [
        ids,
        lengths,
        distinct,
        np.append(starts, len(term)).astype(np.int32),
        np.array(place, np.int32)[order],
        np.array(count, np.int64)[order],
    ]


def shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per shard: ids and lengths of its documents, postings of the vocabulary."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def full() -> pa.RecordBatch:
            columns = _shard(ids, texts, known.value)
            return pa.RecordBatch.from_arrays(
                [pa.array([c], f.type) for c, f in zip(columns, _SHARD)], schema=_SHARD
            )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= SHARD_BYTES:
                    yield full()
                    ids, texts, held = [], [], 0
        if ids:
            yield full()

    return docs.mapInArrow(run, _SHARD_DDL)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_in_shard(query, gains, postings, n_docs: int, best: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best documents of a shard for one query.

    ``query``: terms, rarest first; ``gains``: their weight times repeats;
    ``postings``: term to (places, impacts, largest impact); ``tie``: rank of a
    document among equal scores.
    """
    steps = [(*postings[t], g) for t, g in zip(query, gains) if g > 0 and t in postings]
    rest = np.cumsum([0, *(most * g for _, _, most, g in reversed(steps))])[::-1]
    partial = np.zeros(n_docs, np.int64)
    alive = None
    for (places, impacts, _, gain), left in zip(steps, rest[1:]):
        if alive is not None:
            keep = alive[places]
            places, impacts = places[keep], impacts[keep]
        partial[places] += gain * impacts
        if alive is None and left and n_docs >= best:
            kth = np.partition(partial, n_docs - best)[n_docs - best]
            if left < kth:  # an unseen document stays below; so do those that lack too much
                alive = partial + left >= kth
    found = np.flatnonzero(partial if alive is None else partial * alive)
    if len(found) > best:
        cut = np.partition(partial[found], len(found) - best)[len(found) - best]
        found = found[partial[found] >= cut]
    order = np.lexsort((tie[found], -partial[found]))[:best]
    return found[order], partial[found[order]]


def _answer(spread: DataFrame, queries: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """The best documents of every shard for every query of a block."""
    asked = spread.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight_of = asked.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, starts, places, counts = (c[row].values for c in batch.columns)
                n = lengths.to_numpy()
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                terms, starts, places = terms.to_numpy(), starts.to_numpy(), places.to_numpy()
                tf = counts.to_numpy()
                impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[places])
                postings = {
                    t: (places[a:b], impacts[a:b], int(impacts[a:b].max()))
                    for t, a, b in zip(terms.tolist(), starts[:-1].tolist(), starts[1:].tolist())
                }
                known = ids.to_pylist()
                tie = np.empty(len(known), np.int64)
                tie[sorted(range(len(known)), key=lambda i: (known[i] is None, known[i] or 0))] = np.arange(len(known))
                out: list[list] = [[], [], [], []]
                for number, item, query, repeats in block:
                    where, scores = best_in_shard(
                        query, [int(weight_of[t]) * r for t, r in zip(query, repeats)], postings, len(known), best, tie
                    )
                    out[0] += [number] * len(where)
                    out[1] += [item] * len(where)
                    out[2] += [known[i] for i in where]
                    out[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)

    return spread.mapInArrow(run, _FOUND_DDL)


def _search_block(docs: DataFrame, rows: list, first: int, best: int) -> DataFrame | None:
    """Best documents per shard for some queries; None if no document has a term."""
    held = [Counter(terms_of(r.text or b"")) for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*held)))}
    spread = shared_table(shards(docs, vocabulary), "search-shards")
    totals = spread.agg(
        F.sum(F.size(F.filter("lengths", lambda x: x > 0))).alias("n_docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_terms"),
    ).first()
    if not totals.n_terms:
        return None
    # one row per term of the block's vocabulary
    each = spread.select(
        F.explode(
            F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("starts", i + 1) - F.get("starts", i)).cast("long").alias("df")))
        ).alias("x")
    )
    df = np.zeros(len(vocabulary), np.int64)
    for r in each.groupBy("x.term").agg(F.sum("x.df").alias("df")).collect():
        df[r.term] = r.df
    weights = np.array([weight(totals.n_docs, d) for d in df.tolist()], np.int64)
    queries = []
    for at, (row, count) in enumerate(zip(rows, held)):
        order = sorted((df[i], i, count[w]) for w in count if df[i := vocabulary[w]])
        queries.append((first + at, row.item_id, [i for _, i, _ in order], [r for *_, r in order]))
    return _answer(spread, queries, weights, totals.n_docs, totals.n_terms, best)


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of every item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).cast("string").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16).alias("size")).first().size or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        asked = shared_table(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "search-queries")
    found, first = None, 0
    for block in range(blocks):
        rows = (asked.where(F.col("block") == block) if blocks > 1 else asked).collect()
        part = _search_block(texts, rows, first, best)
        first += len(rows)
        if part is not None:
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], _FOUND_DDL)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), asked AS (
  SELECT qid, item_id, term, count(*) AS q FROM (
    SELECT qid, item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark))
  GROUP BY ALL
), sizes AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes),
postings AS (
  SELECT rid, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, nd
), scores AS (
  SELECT qid, item_id, rid, doc_id,
         sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (rid), totals
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC NULLS LAST) AS r
  FROM scores WHERE score > 0
)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
