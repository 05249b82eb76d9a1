"""Greedy packing of one text's paragraphs.

An order-dependent fold with a result per pack: in the JVM it would copy the
result array at every step, so it runs once over the text in an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = re.compile(r"\n\n+")

#: A pack and where it lies in its text: first character of its first paragraph, end of its last.
PACK = pa.struct([("content", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
PACK_TYPE = "struct<content:string,start:int,end:int>"


def paragraphs(text: str) -> Iterator[tuple[str, int]]:
    """Stripped, non-blank paragraphs and their offsets."""
    start = 0
    for end, following in [*(m.span() for m in _BREAK.finditer(text)), (len(text), 0)]:
        raw = text[start:end]
        if para := raw.strip():
            yield para, start + len(raw) - len(raw.lstrip())
        start = following


def packs_of(text: str, target: int) -> list[dict]:
    """Packs in order; a paragraph longer than ``target`` stays whole.

    A pack closes when the next paragraph would take its paragraph characters
    (separators not counted) over ``target``.
    """
    packs: list[dict] = []
    held: list[str] = []
    used = start = end = 0

    def close() -> None:
        if held:
            packs.append({"content": "\n\n".join(held), "start": start, "end": end})

    for para, at in paragraphs(text):
        if held and used + len(para) > target:
            close()
            held, used = [], 0
        if not held:
            start = at
        held.append(para)
        used += len(para)
        end = at + len(para)
    close()
    return packs


def pack_paragraphs(text: Column, target: int) -> Column:
    """Array of ``(content, start, end)`` per text; null for a null text."""

    @F.arrow_udf(f"array<{PACK_TYPE}>")
    def packs(texts: pa.Array) -> pa.Array:
        made = [None if t is None else packs_of(t, target) for t in texts.to_pylist()]
        return pa.array(made, pa.list_(PACK))

    return packs(text)


def pack_each(texts: Column, target: int) -> Column:
    """The same for every text of an array; null elements have no packs."""

    @F.arrow_udf(f"array<array<{PACK_TYPE}>>")
    def packs(rows: pa.Array) -> pa.Array:
        made = [[[] if t is None else packs_of(t, target) for t in row or ()] for row in rows.to_pylist()]
        return pa.array(made, pa.list_(pa.list_(PACK)))

    return packs(texts)
