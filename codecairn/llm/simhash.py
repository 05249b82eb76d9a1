"""SimHash near-dedup by segment-popcount embedding.

A fingerprint is cut into 16 segments of four bits; its embedding is the number
of set bits in each.  The Manhattan distance of two embeddings is a lower bound
of the Hamming distance of the fingerprints, so fingerprints within two bits
lie within distance two on the grid, and some cell is within distance one of
both.  Each distinct fingerprint is put into the (at most 33) cells within
distance one; those that meet in a cell are compared exactly.

A cell with more than ``CROWD`` fingerprints emits no pairs.  Its fingerprints
are put through the same step with one-bit segments, where the grid is the
Hamming cube itself: two fingerprints share a cell (a word within one bit of
both) exactly when they differ in at most two bits.  Such a cell holds at most
65 fingerprints, and linking each to the smallest of them keeps every
connection.  Nothing is left out and the work stays linear.

Links are contracted to components by hooking roots to smaller roots and
jumping pointers; every round is written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts of fewer than three words have one shingle; repeated rows and ids
each give a row; null ids are ignored as ``component_id`` unless a component
has no other; an empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm.common import shared_table, ship, table, whole_text

SHINGLE = 3
SEED = 42
BITS = 64
MAX_DISTANCE = 2
SEGMENTS, SEGMENT_BITS = 16, 4
#: Fingerprints of one cell that are still compared pair by pair.
CROWD = 16
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(words, words[1:], words[2:])]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype="<u8")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view("<i8"))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Set bits of each segment, one row per fingerprint."""
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), SEGMENTS, SEGMENT_BITS).sum(axis=2, dtype=np.int64)


def cells_within_one(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells within Manhattan distance one, and the row each belongs to."""
    counts = segment_counts(fps)
    base = SEGMENT_BITS + 1
    if not len(fps):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place = base ** np.arange(SEGMENTS, dtype=np.int64)  # 5**16 < 2**63
    own = counts @ place
    rows = np.arange(len(fps))
    cells, owners = [own], [rows]
    for step, limit in ((1, SEGMENT_BITS), (-1, 0)):
        row, segment = np.nonzero(counts != limit)
        cells.append(own[row] + step * place[segment])
        owners.append(row)
    return np.concatenate(cells), np.concatenate(owners)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for at in range(0, len(fps), 2048):
            part = fps[at : at + 2048]
            cells, owners = cells_within_one(part)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part[owners])], names=["cell", "fp"])


def _within(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints linked at two bits.

    ``fps``: distinct fingerprints.  Outside crowded cells every link is an
    edge; inside them a chain of edges through common cells stands for it.
    """
    from pyspark.sql import Window

    placed = fps.mapInArrow(_cells, "cell long, fp long")
    met = shared_table(
        placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where("n > 1"), "simhash-cells"
    )
    group = met.where(F.col("n") <= CROWD).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    pairs = (
        group.select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode("fps").alias("b"))
        .where((F.col("a") < F.col("b")) & _within("a", "b"))
    )
    crowded = met.where(F.col("n") > CROWD).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)))
    shared_cells = (
        crowded.select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("cell"))
        .agg(F.collect_set("fp").alias("fps"))  # at most 65
        .where(F.size("fps") > 1)
    )
    stars = (
        shared_cells.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where((F.col("a") < F.col("b")) & _within("a", "b"))
    )
    return pairs.unionAll(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge; equal roots are connected.

    Every node but the smallest of its neighbourhood hooks to its smallest
    neighbour, and pointers jump, twice as far each time, to the ends of their
    chains before edges are drawn between those ends.
    """
    edges = shared_table(edges, "simhash-edges")
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    roots = shared_table(ends.select("node", F.col("node").alias("root")), "simhash-roots")
    while not edges.isEmpty():
        hooks = shared_table(
            edges.select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new"))
            .groupBy("old")
            .agg(F.min("new").alias("new")),
            "simhash-hooks",
        )
        while True:  # until every pointer is at its root
            upper = hooks.select(F.col("old").alias("new"), F.col("new").alias("upper"))
            jumped = hooks.join(upper, "new", "left").select(
                "old", F.coalesce("upper", "new").alias("new"), F.col("upper").isNotNull().alias("moved")
            )
            jumped = shared_table(jumped, "simhash-jump")
            hooks = jumped.select("old", "new")
            if jumped.where("moved").isEmpty():
                break
        moved = hooks.select(F.col("old").alias("root"), "new")
        roots = shared_table(
            roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "simhash-roots"
        )
        for end in ("a", "b"):
            to = hooks.select(F.col("old").alias(end), F.col("new").alias("to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = shared_table(edges.where("a <> b").select("a", "b").distinct(), "simhash-edges")
    return roots


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = shared_table(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    classes = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    joined = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    named = shared_table(classes.join(joined, "fp", "left").select("fp", "first", "root"), "simhash-named")
    smallest = shared_table(
        named.where("root is not null").groupBy("root").agg(F.min("first").alias("smallest")), "simhash-smallest"
    )
    of_class = shared_table(
        named.join(smallest, "root", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")),
        "simhash-components",
    )
    return marked.join(of_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
