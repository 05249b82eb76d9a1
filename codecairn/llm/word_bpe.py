"""Byte-level BPE by a global shuffle of distinct words.

Encoding

1. Tasks cut texts into words where the pre-token pattern certainly cuts too and
   gather runs of documents into batches of bounded size.  A batch keeps, for
   each document, the positions of its words in the batch's own word list.
2. The distinct words of each batch travel to a bucket given by the word's hash,
   sorted and compressed, so a word of the whole corpus lies in one task however
   many documents use it.  That task encodes each distinct word once, and sends
   its ids back to the batches.
3. Each batch gets its word ids and puts its documents together by position.

A frequent word is one entry per batch, not one row per occurrence, so no key
grows hot.  Everything that crosses a shuffle is compressed columns, and the
batches are kept bucketed, so only the answers move to join them.

Decoding looks ids up in the token-byte table, one row per token of the
vocabulary file and thus of bounded size.

Defined results: a null or empty text has no ids and decodes to nothing; repeated
rows and ids each give a row; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from codecairn.llm.common import shared_path, ship, space_led_words, table, vocabulary, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A batch is closed when it holds so many characters, or so many documents.
BATCH_CHARS, BATCH_DOCS = 14_000_000, 50_000
#: The most frequent words of a batch get the smallest numbers, which compress best.
FREQUENT = 1 << 16
#: Documents taken out of an Arrow batch at once.
SLICE = 1000
#: Documents handed on at once when texts are put together.
OUT_DOCS, OUT_BYTES = 500, 16_000_000

_SENT = (
    "batch long, doc_ids array<long>, n_words binary, frequent binary, places binary, "
    "buckets array<struct<bucket:int,words:binary>>"
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


_encodings: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    """One encoder per vocabulary and process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        _encodings[path, pattern] = tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}
        )
    return _encodings[path, pattern]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: all low bytes, then the next ones; high ones are nearly constant."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes, offset: int = 0, n: int = -1) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, -1 if n < 0 else 4 * n, offset)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    lengths = np.array([len(w) for w in words])
    return _pack(len(words).to_bytes(4, "little") + _planes(lengths) + "".join(words).encode("utf-8"))


def _unpack_words(data: bytes) -> list[str]:
    raw = _unpack(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_from_planes(raw, 4, n)).tolist()
    text = raw[4 + 4 * n :].decode("utf-8")
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _send(buckets: int):
    """Documents to batches: word positions, and the distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[int] = []
        known: dict[str, int] = {}
        places: list[np.ndarray] = []
        chars = 0

        def batch_row() -> pa.RecordBatch:
            by: dict[int, list[str]] = {}
            for word in known:
                by.setdefault(zlib.crc32(word.encode("utf-8")) % buckets, []).append(word)
            order, sent, at = np.empty(len(known), dtype="<u4"), [], 0
            for bucket in sorted(by):
                words = sorted(by[bucket])
                for word in words:
                    order[known[word]] = at
                    at += 1
                sent.append({"bucket": bucket, "words": _pack_words(words)})
            flat = np.concatenate(places)
            often = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")[:FREQUENT]
            number = order + len(often)
            number[often] = np.arange(len(often))
            values = (
                serial, ids, _pack(_planes(np.array(sizes))), _pack(_planes(order[often])),
                _pack(_planes(number[flat])), sent,
            )
            kinds = (
                pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(),
                pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=t) for v, t in zip(values, kinds)],
                names=["batch", "doc_ids", "n_words", "frequent", "places", "buckets"],
            )

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = space_led_words(text)
                for word in set(words).difference(known):
                    known[word] = len(known)
                places.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
                ids.append(doc_id)
                sizes.append(len(words))
                chars += len(text)
                if chars >= BATCH_CHARS or len(ids) >= BATCH_DOCS:
                    yield batch_row()
                    serial += 1
                    ids, sizes, known, places, chars = [], [], {}, [], 0
        if ids:
            yield batch_row()

    return run


def _encode_words(path: str, pattern: str):
    """Bucket rows: the ids of each word; every distinct word of the task is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoding(path, pattern).encode_ordinary, {}
        bucket = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != bucket:  # rows come sorted by bucket: words of another one don't return
                    bucket, known = row["bucket"], {}
                words = _unpack_words(row["words"])
                for word in words:
                    if word not in known:
                        known[word] = np.array(encode(word), dtype="<u4").tobytes()
                found = [known[w] for w in words]
                sizes, ids = np.array([len(f) // 4 for f in found]), np.frombuffer(b"".join(found), "<u4")
                out.append((row["batch"], row["bucket"], len(words), _pack(_planes(sizes) + _planes(ids))))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["batch", "bucket", "n", "ids"])

    return run


def _id_names(ids: np.ndarray) -> str:
    """Decimal ids joined by one space."""
    return " ".join(map(str, ids.tolist()))


def _assemble(with_digest: bool):
    """Batch rows with their answers: the ids of each document."""

    def documents(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "n_tokens", "ids", *["ids_sha256"] * with_digest]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            row = one.to_pylist()[0]
            sizes, ids = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
            for answer in sorted(row["answers"] or [], key=lambda a: a["bucket"]):
                raw = _unpack(answer["ids"])
                sizes.append(_from_planes(raw, 0, answer["n"]))
                ids.append(_from_planes(raw, 4 * answer["n"]))
            size, all_ids = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
            first = np.cumsum(size) - size
            words = np.concatenate([_from_planes(_unpack(row["frequent"])), np.arange(len(size), dtype="<u4")])
            numbers = _from_planes(_unpack(row["places"]))
            if len(numbers) and int(numbers.max()) >= len(words):
                raise ValueError("a batch lacks the ids of some of its words")
            done, held, out = 0, 0, []
            for doc_id, n in zip(row["doc_ids"], _from_planes(_unpack(row["n_words"])).tolist()):
                word = words[numbers[done : done + n]]
                done += n
                long = size[word]
                ends = np.cumsum(long)
                total = int(ends[-1]) if n else 0
                # positions of every id: the word's first one, then running on
                index = np.repeat(first[word] - (ends - long), long) + np.arange(total)
                code = all_ids[index]
                digest = (hashlib.sha256(_id_names(code).encode()).hexdigest(),) * with_digest
                out.append((doc_id, total, code.tobytes(), *digest))
                held += 4 * total
                if len(out) >= OUT_DOCS or held >= OUT_BYTES:
                    yield documents(out)
                    out, held = [], 0
            if out:
                yield documents(out)

    return run


def _bucketed(sent: DataFrame, buckets: int) -> DataFrame:
    """Batches as a table bucketed by batch in the shared folder: joining on batch moves nothing of it."""
    spark = sent.sparkSession
    path = shared_path(spark, "bpe_batches")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    sent.write.bucketBy(buckets, "batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    with_digest: bool = False,
) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; ids as little-endian unsigned 32-bit integers.

    ``with_digest`` adds ``ids_sha256`` of the decimal ids joined by one space.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary_path or vocabulary(VOCABULARY)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    sent = _bucketed(texts.mapInArrow(_send(width), _SENT), width)
    answers = (
        sent.select("batch", F.explode("buckets").alias("b"))
        .select("batch", F.col("b.bucket").alias("bucket"), F.col("b.words").alias("words"))
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(path, pattern), "batch long, bucket int, n int, ids binary")
    )
    # one answer per bucket and batch, so the list is as bounded as the batch
    gathered = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "ids")).alias("answers"))
    digest = ", ids_sha256 string" if with_digest else ""
    return (
        sent.select("batch", "doc_ids", "n_words", "frequent", "places")
        .join(gathered, "batch", "left")
        .mapInArrow(_assemble(with_digest), "doc_id long, n_tokens long, ids binary" + digest)
    )


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes of each id."""
    ranks = read_ranks(path)
    found = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def decode(coded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows with ``ids``."""
    ship(coded.sparkSession)
    path = vocabulary_path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = token_bytes(path).__getitem__
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = [b"".join(map(look_up, np.frombuffer(b.as_buffer(), "<u4").tolist())) for b in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.binary())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), with_digest=True)
    return decode(coded).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
