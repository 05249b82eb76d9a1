"""LM scoring: online logistic mixing of hashed-context bit predictors.

Every text gets its log probability under a model of the training texts, and
under a plain word model beside it.  The predictors, their mixing and its
refinement within a text are in ``context_mixing``; this module is how the
corpus teaches them:

1. Tasks read the documents in batches and leave, per batch, its distinct units,
   the order they come in, and what it asks: each distinct (context, byte) and
   each distinct word, with its occurrences in training texts.
2. The questions meet by hash range.  The counts of all batches are summed there
   and each batch is answered with one state byte per decision, and with the
   counts of its words.  The number of ranges grows with the corpus and a
   context is asked for once per batch, so no range is large or hot.
3. Each batch reads its texts; every text starts from the same mixing weights
   and refines its own.

No table of the model is held whole anywhere; the width of the context hash is
set by the bytes of the training texts.

Defined results: a null text counts as empty and still has its end; a null id
counts as an empty string in the rule that holds documents out.  Repeated rows
are scored each; an empty table gives an empty result.  A text of more than
``SEGMENT`` bytes is read in segments, cut behind blanks, each starting from the
first weights.  Only the id and text columns are read, so clashing names do no
harm.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm import context_mixing as cm
from codecairn.llm.common import shared_table, ship, table, whole_text

#: Bytes of text in a batch, and in a segment of a long text.
BATCH = SEGMENT = 6_000_000
#: Bytes of text per hash range of the questions.
RANGE = 16_000_000
#: A document is held out if its id's checksum leaves this remainder.
FOLDS, HELD_OUT = 7, 2

_BATCHES = pa.schema(
    [
        ("batch", pa.int64()),
        ("row", pa.list_(pa.int64())),
        ("doc_id", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("n_bytes", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("sequence", pa.binary()),
        ("units", pa.binary()),
        ("unit_sizes", pa.binary()),
        ("unit_words", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("asked", pa.list_(pa.struct([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))),
    ]
)
_BATCHES_DDL = (
    "batch bigint, row array<bigint>, doc_id array<bigint>, held_out array<boolean>, n_bytes array<bigint>, "
    "sizes array<int>, sequence binary, units binary, unit_sizes binary, unit_words binary, pairs array<bigint>, "
    "asked array<struct<part:int,keys:binary,counts:binary>>"
)
_ANSWER_DDL = "batch bigint, part int, answer binary, n_known bigint, n_tokens bigint"
_SCORES_DDL = (
    "row bigint, doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, bits double"
)


def _words(units: list[bytes], parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of units, their parts in ascending order, each unit's word (last: none)."""
    words = [u[:-1] for u in units]  # without the blank or the end behind it
    distinct = sorted(set(words) - {b""})
    part = np.array([zlib.crc32(w) % parts for w in distinct], np.int64)
    order = np.argsort(part, kind="stable")
    dealt = [distinct[i] for i in order]
    place = {w: i for i, w in enumerate(dealt)}
    return dealt, part[order], np.array([place.get(w, len(dealt)) for w in words], np.uint32)


class _Batch:
    """Segments of texts, their units numbered."""

    def __init__(self):
        self.known: dict[bytes, int] = defaultdict(count().__next__)  # a new unit gets the next number
        self.row, self.doc_id, self.held_out, self.n_bytes, self.sequences = [], [], [], [], []
        self.held = 0

    def add(self, row: int, doc_id: int | None, held_out: bool, segment: bytes, last: bool) -> None:
        units = cm.units_of(segment, last)
        self.sequences.append(np.fromiter(map(self.known.__getitem__, units), np.uint32, len(units)))
        self.row.append(row)
        self.doc_id.append(doc_id)
        self.held_out.append(held_out)
        self.n_bytes.append(len(segment))
        self.held += len(segment) + 1

    def record(self, batch: int, bits: int, parts: int) -> pa.RecordBatch:
        names = list(self.known)
        taught = [s for s, h in zip(self.sequences, self.held_out) if not h]
        counts = np.bincount(np.concatenate([*taught, np.zeros(0, np.uint32)]), minlength=len(names))
        whole = b"".join(names)
        units = cm.Units(whole, np.array([len(u) for u in names]))
        keys, places = cm.distinct_keys(units, bits)
        weight = cm.key_counts(units, places, counts, len(keys))
        cuts = np.searchsorted(keys, [(p << (bits + 16)) // parts for p in range(parts + 1)]) if parts > 1 else [0, len(keys)]
        asked = [
            {"part": p, "keys": cm.pack(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": cm.pack(weight[a:b].astype(np.uint32))}
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
            if b > a
        ]
        words, part, of_unit = _words(names, parts)
        spoken = np.bincount(of_unit, counts, len(words) + 1).astype(np.uint32)
        press = zstandard.ZstdCompressor(level=3).compress
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                asked.append({"part": parts + p, "keys": press(b" ".join(words[a:b])), "counts": cm.pack(spoken[a:b])})
        columns = [
            batch, self.row, self.doc_id, self.held_out, self.n_bytes,
            [len(s) for s in self.sequences],
            cm.pack(np.concatenate(self.sequences)),
            press(whole),
            cm.pack(units.size.astype(np.uint32)),
            cm.pack(of_unit),
            np.bincount(units.pair, counts[units.unit], 65536).astype(np.int64),
            asked,
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _BATCHES)], schema=_BATCHES)


def batches_of(texts: DataFrame, bits: int, parts: int) -> DataFrame:
    """Batches of ``(doc_id, held_out, text as bytes)``."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made, rows, batch = 0, 0, _Batch()
        for record in records:
            for i, held_out, text in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), record.column(2)):
                segments = cm.segments_of(text.as_py().lower(), SEGMENT)
                for k, segment in enumerate(segments):
                    if batch.held and batch.held + len(segment) > BATCH:
                        yield batch.record(base + made, bits, parts)
                        made, batch = made + 1, _Batch()
                    batch.add(base + rows, i, held_out, segment, k == len(segments) - 1)
                rows += 1
        if batch.held:
            yield batch.record(base + made, bits, parts)

    return texts.mapInArrow(run, _BATCHES_DDL)


def _answer_contexts(asked: pd.DataFrame, code: cm.Code) -> list[bytes]:
    keys = [np.cumsum(cm.unpack(k, np.uint64)) for k in asked["keys"]]
    counts = [cm.unpack(c, np.uint32) for c in asked["counts"]]
    together = np.concatenate(keys)
    which, distinct = pd.factorize(together)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct, which = distinct[order], rank[which]
    state = cm.states(distinct, np.bincount(which, np.concatenate(counts), len(distinct)), code)
    length = code.length[(distinct & np.uint64(65535)).astype(np.int64)].astype(np.int64)
    first, out, at = np.cumsum(length) - length, [], 0
    for k in keys:
        own = which[at : at + len(k)]
        n = length[own]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(cm.pack(state[np.repeat(first[own], n) + within]))
        at += len(k)
    return out


def _answer_words(asked: pd.DataFrame) -> tuple[list[bytes], int, int]:
    unzip = zstandard.ZstdDecompressor().decompress
    words = [unzip(k).split(b" ") for k in asked["keys"]]
    which, distinct = pd.factorize(np.array([w for part in words for w in part], object))
    total = np.bincount(which, np.concatenate([cm.unpack(c, np.uint32) for c in asked["counts"]]), len(distinct)).astype(np.int64)
    out, at = [], 0
    for part in words:
        out.append(cm.pack(total[which[at : at + len(part)]]))
        at += len(part)
    return out, int((total > 0).sum()), int(total.sum())


def answers_of(batches: DataFrame, code: cm.Code, parts: int) -> DataFrame:
    """What each batch asked, answered from the counts of all; sums of the word ranges."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        part, n_known, n_tokens = int(asked["part"].iloc[0]), 0, 0
        if part < parts:
            answers = _answer_contexts(asked, code)
        else:
            answers, n_known, n_tokens = _answer_words(asked)
        out = pd.DataFrame({"batch": asked["batch"], "part": part, "answer": answers, "n_known": 0, "n_tokens": 0})
        out.loc[out.index[0], ["n_known", "n_tokens"]] = [n_known, n_tokens]
        return out

    each = batches.select("batch", F.explode("asked").alias("a")).select("batch", "a.*")
    return each.groupBy("part").applyInPandas(run, _ANSWER_DDL)


def _decisions(answers: list[dict], units: cm.Units, bits: int, parts: int, code: cm.Code) -> tuple[cm.Decisions, np.ndarray]:
    """The decisions of a batch's units, and the counts of its words (last: none)."""
    ordered = sorted(answers, key=lambda a: a["part"])
    state = np.concatenate([cm.unpack(a["answer"], np.uint8) for a in ordered if a["part"] < parts])
    words = [cm.unpack(a["answer"], np.int64) for a in ordered if a["part"] >= parts]
    keys, places = cm.distinct_keys(units, bits)
    return cm.Decisions(units, places, keys, state, code), np.concatenate([*words, np.zeros(1, np.int64)])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    ship(spark)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    held_out = F.pmod(F.crc32(name), F.lit(FOLDS)) == HELD_OUT
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), whole_text(text_col).cast("binary").alias("text"))
    size = texts.agg(
        F.sum(F.when(~F.col("held_out"), F.length("text") + 1)).alias("taught"),
        F.sum(F.length("text") + 1).alias("bytes"),
        F.count_if(~F.col("held_out")).alias("ends"),
    ).first()
    bits = max(28, math.ceil(math.log2((size.taught or 0) + 1)) - 1)
    parts = max(1, -(-(size.bytes or 0) // RANGE))
    batches = shared_table(batches_of(texts, bits, parts), "lm-batches")
    pairs = np.zeros(65536, np.int64)
    for r in batches.select(F.posexplode("pairs")).where("col > 0").groupBy("pos").agg(F.sum("col").alias("n")).collect():
        pairs[r.pos] = r.n
    code = cm.Code(pairs)
    answers = shared_table(answers_of(batches, code, parts), "lm-answers")
    known = answers.agg(F.sum("n_known").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    n_ends = int(size.ends)
    distinct, n_train = (known.words or 0) + (n_ends > 0), (known.tokens or 0) + n_ends

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for r in record.to_pylist():
                whole = zstandard.ZstdDecompressor().decompress(r["units"])
                units = cm.Units(whole, cm.unpack(r["unit_sizes"], np.uint32))
                decisions, total = _decisions(r["answers"], units, bits, parts, code)
                of_unit, ends = cm.unpack(r["unit_words"], np.uint32), units.ends
                is_word, total = of_unit < len(total) - 1, total[of_unit]
                sequence, sizes = cm.unpack(r["sequence"], np.uint32), np.array(r["sizes"], np.int64)
                mass = n_train + (distinct + 1)
                logs = np.where(is_word, np.log10((total + 1) / mass), 0.0) + np.where(ends, np.log10((n_ends + 1) / mass), 0.0)
                text = np.repeat(np.arange(len(sizes)), sizes)

                def each(x):
                    return np.bincount(text, x[sequence], len(sizes))

                n_known = each((is_word & (total > 0)).astype(float) + (ends & (n_ends > 0)))
                bits_of = cm.log2_likelihood(decisions, sequence, sizes)
                columns = [
                    r["row"], r["doc_id"], r["held_out"], r["n_bytes"], each(is_word.astype(float) + ends).astype(np.int64),
                    n_known.astype(np.int64), each(logs), bits_of,
                ]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                names = ["row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "bits"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    gathered = answers.groupBy("batch").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))
    asked = gathered.join(batches.drop("asked", "pairs"), "batch")
    scored = asked.mapInArrow(run, _SCORES_DDL)
    total = scored.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        *(F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base_score", "bits")),
    )
    return total.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("bits") * math.log10(2)).alias("score"),
        "n_bytes",
        (-F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
