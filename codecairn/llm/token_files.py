"""Token-ID output: dictionary-compressed documents with an offset index.

File format, a folder in any store Spark can write:

- ``dictionary``: one row ``(sha256, bytes, id_bytes)``, the shared zstandard
  dictionary and the width of a serialized id;
- ``blocks``: one row per block of consecutive documents in ascending id order,
  ``payload`` holding one zstandard frame per document, back to back, each
  compressed alone with the dictionary; ``offsets`` (one more than documents)
  says where each frame starts, ``first_id``/``last_id`` let a reader skip
  blocks by file statistics, ``part``/``start_in_part`` place the block's ids in
  the whole sequence, ``dict_sha256`` names the dictionary the frames need.

One document is read by fetching its block row, slicing one frame and
decompressing that alone.  Spark's own commit protocol writes the files, so a
lost executor leaves no half block.

The dictionary is trained on at most ``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` characters, those whose texts have the smallest hashes; this bound
affects compression only.  Every document is written.

Defined results: a null or empty text is the end id alone; null ids come first;
rows with equal ids are ordered by a hash of their text, then by it; an empty
table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm.common import encoder, shared_path, ship, table, vocabulary, whole_text

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Vocabularies of up to 65,536 ids are stored in two bytes an id.
ID_BYTES = 2
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 8192
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
LEVEL = 3

_BLOCKS = (
    "part int, start_in_part long, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, "
    "offsets array<long>, payload binary, dict_sha256 string"
)


def _encoded(path: str, end_id: int, id_bytes: int, texts: list[str]) -> Iterator[bytes]:
    end = end_id.to_bytes(id_bytes, "little")
    for ids in encoder(path, space_led=False, width=id_bytes).ids(texts):
        yield ids + end


def train_dictionary(texts: DataFrame, path: str, end_id: int, id_bytes: int) -> bytes:
    """Dictionary bytes; empty when there is too little to learn from."""
    short = texts.where(F.length("text") <= SAMPLE_CHARS).select(F.xxhash64("text").alias("h"), "text")
    lowest = short.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first().h
    if lowest is None:
        return b""
    rows = short.where(F.col("h") <= lowest).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    sample = [r.text for r in rows]
    samples = list(_encoded(path, end_id, id_bytes, sample))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _to_blocks(path: str, end_id: int, id_bytes: int, dictionary: bytes):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        part, start = TaskContext.get().partitionId(), 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            row = {
                "part": part, "start_in_part": start, "first_id": ids[0], "last_id": ids[-1], "doc_ids": ids,
                "n_tokens": counts, "offsets": list(accumulate(map(len, frames), initial=0)),
                "payload": b"".join(frames), "dict_sha256": digest,
            }
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for doc_id, code in zip(batch.column("doc_id").to_pylist(), _encoded(path, end_id, id_bytes, batch.column("text").to_pylist())):
                frame = pressed.compress(code)
                ids.append(doc_id)
                counts.append(len(code) // id_bytes)
                frames.append(frame)
                held += len(frame)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    start += sum(counts)
                    ids, counts, frames, held = [], [], [], 0
        if ids:
            yield block()

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
    id_bytes: int = ID_BYTES,
) -> None:
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary_path or vocabulary(VOCABULARY)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    dictionary = train_dictionary(texts, path, end_id, id_bytes)
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), dictionary, id_bytes)], "sha256 string, bytes binary, id_bytes int"
    ).coalesce(1).write.parquet(f"{folder}/dictionary")
    order = ["doc_id", F.xxhash64("text"), "text"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        texts.repartitionByRange(width, *order[:2])
        .sortWithinPartitions(*order)
        .mapInArrow(_to_blocks(path, end_id, id_bytes, dictionary), _BLOCKS)
        .write.parquet(f"{folder}/blocks")
    )


def _read_dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.bytes)
    if hashlib.sha256(data).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not match its hash")
    return data, row.sha256, row.id_bytes


def _unpack(batch: pa.RecordBatch, dictionary: bytes, digest: str, id_bytes: int):
    """``(row, position, doc_id, ids)`` of each document of the batch's blocks."""
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for k, row in enumerate(batch.select(["doc_ids", "offsets", "payload", "dict_sha256"]).to_pylist()):
        if row["dict_sha256"] != digest:
            raise ValueError("a block needs another dictionary")
        payload = memoryview(row["payload"])
        for j, doc_id in enumerate(row["doc_ids"]):
            code = opener.decompress(payload[row["offsets"][j] : row["offsets"][j + 1]])
            yield k, j, doc_id, np.frombuffer(code, dtype=f"<u{id_bytes}").astype("<u4")


def read_token_files(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    With ``checksums`` their crc32, ``ids_crc32``, comes instead of the ids, computed
    where they are unpacked: no ids leave the Python worker, and no second one is held.
    """
    ship(spark)
    dictionary, digest, id_bytes = _read_dictionary(spark, folder)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    # one number per part of the writing job
    sizes = blocks.groupBy("part").agg(F.max(F.col("start_in_part") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    parts = sorted((r.part, r.n) for r in sizes.collect())
    bases = dict(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=0)))
    last = "ids_crc32" if checksums else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                start = bases[one.column("part")[0].as_py()] + one.column("start_in_part")[0].as_py()
                rows = []
                for _, _, doc_id, ids in _unpack(one, dictionary, digest, id_bytes):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids) if checksums else ids.tobytes()))
                    start += len(ids)
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if checksums else pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", last])

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if checksums else 'binary'}")


def fetch_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of a few documents: only their blocks are read, only their frames opened."""
    ship(spark)
    dictionary, digest, id_bytes = _read_dictionary(spark, folder)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    wanted = frozenset(doc_ids)
    reach = F.lit(False)
    for doc_id in sorted(wanted):
        reach = reach | ((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("a block needs another dictionary")
                for j, doc_id in enumerate(row["doc_ids"]):
                    if doc_id in wanted:
                        code = opener.decompress(row["payload"][row["offsets"][j] : row["offsets"][j + 1]])
                        ids = np.frombuffer(code, dtype=f"<u{id_bytes}").astype("<u4").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.binary())], names=["doc_id", "ids"])

    return blocks.where(reach).mapInArrow(run, "doc_id long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, checksums=True)
