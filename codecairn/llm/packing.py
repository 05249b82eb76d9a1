"""Best-fit packing of all documents by bin completion.

1. Tasks encode whole documents and emit one narrow row per piece (id, piece,
   start, length, checksum).  Only documents longer than a sequence are cut; the
   remainder comes first, so every later piece fills a sequence alone.
2. The histogram of piece lengths has at most ``CAPACITY`` rows whatever the
   corpus size.  Bin completion (``bin_completion``) solves it on the driver as
   patterns with multiplicities.
3. Pieces of equal length are interchangeable.  Each gets its rank among those of
   its length (count per task, prefix sums over tasks, running number inside a
   task), and the rank determines pattern, sequence and offset.

Defined results: a null or empty text is the end id alone; repeated rows and ids
are packed as often as they occur; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecairn.llm.bin_completion import NODE_LIMIT, Pattern, bin_completion
from codecairn.llm.common import encoder, shared_table, ship, table, vocabulary, whole_text

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)``: the remainder first, then whole sequences."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces_of(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, ranks = encoder(path, space_led=True), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.ids(batch.column("text").to_pylist())):
                ids = memoryview(ids + end)
                for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, k, start, length, crc, part, ranks[length]))
                    ranks[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


def slots(patterns: list[tuple[Pattern, int]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies per sequence, first sequence, offset), ascending by rank."""
    by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            by[length].append((used[length], copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in by.items()}


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                at = np.nonzero(length == n)[0]
                rows = by[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + inside // row[:, 1]
                offset[at] = row[:, 3] + inside % row[:, 1] * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    path = vocabulary_path or vocabulary(VOCABULARY)
    pieces = shared_table(texts.mapInArrow(_pieces_of(path, capacity, end_id), _PIECES), "packing-pieces")
    per_part = shared_table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-parts")
    # at most `capacity` rows
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(bin_completion(histogram, capacity, node_limit), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )
    return ranked.mapInArrow(
        _placed(places),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
