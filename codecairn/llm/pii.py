"""PII: personal data in plain and in disguised form, with source offsets.

Plain e-mail addresses, IP addresses, payment cards and phone numbers are found
as they stand (base spans).  Then transducers rewrite disguises:

- lookalike letters and digits (other scripts, full width) become ASCII, and
  invisible characters vanish;
- digits spelled as words become digits, "plus" before them "+";
- "[at]", "(dot)" and the like, and bare "at"/"dot" words between parts of an
  address, become "@" and ".".

Each rewrite is an edit of a source range, so spans found in the rewritten text
map back to source characters.  Base spans stay; spans that touch an edit are
added.  All scans are linear in the text.

Defined results: a null or empty text has no spans; offsets count code points,
end exclusive; repeated rows each give a row; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecairn.llm.common import ship, table, whole_text

KINDS = ("email", "ip", "card", "phone")

#: (kind, start, end)
Span = tuple[str, int, int]
#: (start, end, replacement)
Edit = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each "@": the run before it, the domain after it."""
    at, end = text.find("@"), 0
    previous = -1
    while at >= 0:
        if at >= end:
            floor = max(end, previous + 1)
            start = at - len(_LOCAL.match(text[floor:at][::-1])[0])
            if start < at and (domain := _DOMAIN.match(text, at + 1)):
                end = domain.end()
                yield start, end
        previous = at
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Base spans, by kind as listed, then start."""
    found: list[Span] = []
    if "@" in text:
        found += (("email", a, b) for a, b in _emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "ս": "u", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
    "χ": "x", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "∙": ".", "·": ".",
}
# Characters without width.
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Names of the digits in four languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arobase", "arroba")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más", "mas")
#: A bare "at" before a domain with real dots counts only with one of these endings.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")

_ODD = re.compile(
    "[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "٠-٩۰-۹०-९！-～\U0001d400-\U0001d7ff]"
)
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKETED = re.compile(rf"[ \t]?{_OPEN}[ \t]?(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))[ \t]?{_CLOSE}[ \t]?", re.I)
_LABEL = r"[A-Za-z0-9-]++"
_BARE_DOT = rf"(?:[ \t]++(?:{_DOT})[ \t]++)"
_BARE_AT = re.compile(rf"[ \t]++(?:{_AT})[ \t]++", re.I)
_BARE_DOMAIN = re.compile(rf"{_LABEL}(?:(?:{_BARE_DOT}|\.){_LABEL})++", re.I)
_DOTS = re.compile(_BARE_DOT, re.I)
_ENDS = re.compile(rf"\.(?:{'|'.join(ENDINGS)})\Z", re.I)
# A dotted host whose dots are words, after "@" or between numbers.
_WORDED = re.compile(rf"(?<=[A-Za-z0-9]){_BARE_DOT}(?=[A-Za-z0-9])", re.I)
_AFTER_AT = re.compile(r"(?:@|[\])}>])[ \t]?[A-Za-z0-9.-]{1,80}\Z")
_NAME = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = rf"(?:[ \t,-]{{1,2}}|{_BARE_DOT})"
_SPELLED = re.compile(
    rf"\b(?:(?P<plus>{'|'.join(PLUS_WORDS)})[ \t,-]{{1,2}})?(?:{_NAME}|[0-9])(?:{_GAP}(?:{_NAME}|[0-9]))++\b", re.I
)
_DIGIT_NAME = re.compile(rf"{_NAME}|[0-9]", re.I)
_HAS_NAME = re.compile(rf"\b(?:{_NAME}){_GAP}(?:{_NAME}|[0-9])\b|\b[0-9]{_GAP}(?:{_NAME})\b", re.I)


def rewrite(text: str, edits: list[Edit]) -> str:
    parts, done = [], 0
    for start, end, new in edits:
        parts += (text[done:start], new)
        done = end
    parts.append(text[done:])
    return "".join(parts)


class SourceMap:
    """Positions of a rewritten text in its source."""

    def __init__(self, edits: list[Edit]):
        self.edits, self.at, shift = edits, [], 0
        for start, end, new in edits:
            self.at.append(start + shift)  # where the edit begins in the rewritten text
            shift += len(new) - (end - start)

    def _place(self, position: int, is_end: bool) -> int:
        # an end at an edit's start lies before the edit, a start there lies in it
        k = bisect_right(self.at, position - 1 if is_end else position) - 1
        if k < 0:
            return position
        start, end, new = self.edits[k]
        into = position - self.at[k]
        if into < len(new) or (is_end and into == len(new) and new):
            return end if is_end else start
        return end + into - len(new)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start, False), self._place(end, True)


def lookalike_edits(text: str) -> list[Edit]:
    edits = []
    for m in _ODD.finditer(text):
        c = m[0]
        if c in INVISIBLE:
            new = ""
        elif (new := LOOKALIKES.get(c)) is None:
            digit = unicodedata.decimal(c, None)
            new = unicodedata.normalize("NFKC", c) if digit is None else str(digit)
            if len(new) != 1 or not new.isascii():
                continue
        edits.append((m.start(), m.end(), new))
    return edits


def spelled_edits(text: str) -> list[Edit]:
    if not _HAS_NAME.search(text):
        return []
    edits = []
    for m in _SPELLED.finditer(text):
        names = list(_DIGIT_NAME.finditer(text, m.end("plus") if m["plus"] else m.start(), m.end()))
        if all(len(n[0]) == 1 for n in names):
            continue  # plain digits are not disguised
        if m["plus"]:
            edits.append((m.start(), names[0].start(), "+"))
        for k, n in enumerate(names):
            end = names[k + 1].start() if k + 1 < len(names) else n.end()
            digit = n[0] if len(n[0]) == 1 else DIGIT_WORDS[n[0].lower()]
            dot = "." if _DOTS.fullmatch(text, n.end(), end) else ""
            edits.append((n.start(), end, digit + dot))
    return edits


def address_edits(text: str) -> list[Edit]:
    """Edits of "at" and "dot" in their disguises; found on the text as the other steps leave it."""
    edits = [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]
    has_at = bool(edits) or "@" in text
    for m in _BARE_AT.finditer(text):
        before = text[m.start() - 1] if m.start() else " "
        domain = _BARE_DOMAIN.match(text, m.end())
        if not domain or not (before.isascii() and (before.isalnum() or before in "._%+-")):
            continue
        if _DOTS.search(domain[0]) or _ENDS.search(domain[0]):
            edits.append((m.start(), m.end(), "@"))
            edits += ((domain.start() + d.start(), domain.start() + d.end(), ".") for d in _DOTS.finditer(domain[0]))
    if has_at or _DIGIT.search(text):
        # dots in words after a written or bracketed "at", and between numbers
        for d in _WORDED.finditer(text):
            left, right = text[d.start() - 1], text[d.end()]
            before = text[max(0, d.start() - 90) : d.start()]
            if (left.isdigit() and right.isdigit()) or _AFTER_AT.search(before):
                edits.append((d.start(), d.end(), "."))
    kept: list[Edit] = []
    for edit in sorted(set(edits)):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept


def disguised_spans(text: str) -> list[Span]:
    """Spans that show only after rewriting, in source offsets."""
    passes: list[SourceMap] = []
    now = text
    for finder in (lookalike_edits, spelled_edits, address_edits):
        if edits := finder(now):
            passes.append(SourceMap(edits))
            now = rewrite(now, edits)
    if not passes:
        return []
    found = []
    for kind, start, end in plain_spans(now):
        for step in reversed(passes):
            start, end = step.span(start, end)
        found.append((kind, start, end))
    base = set(plain_spans(text))
    return [s for s in found if s not in base]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added ones together, both in the listed order."""
    base = plain_spans(text)
    added = disguised_spans(text)
    every = sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """Overlapping spans merge; each becomes the name of its first kind in brackets."""
    parts, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        parts += (text[done:a], f"[{kind.upper()}]")
        done = b
    parts.append(text[done:])
    return "".join(parts)


_FOUND = T.StructType(
    [
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("n_added", T.LongType()),
        T.StructField("base", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("masked", T.StringType()),
    ]
)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            whole = text or ""
            base, every = all_spans(whole)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, len(every) - len(base), spans_text(base), spans_text(every), mask(whole, every) if every else text))
        columns = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64()] * 5 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array(c, type=t) for c, t in zip(columns, kinds))], names=["row", *_FOUND.names]
        )


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the document), counts of base spans, ``spans`` and the ``masked`` text."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_found, T.StructType([rows.schema["row"], *_FOUND.fields]))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text("text").alias("text"))
    return find_pii(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        *(f"n_{k}" for k in KINDS),
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
        "n_added",
    )
