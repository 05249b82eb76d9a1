"""Chunking of markdown documents and of code elements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecairn.functions.packing import pack_each
from codecairn.functions.text import (
    WHITESPACE,
    content_hash,
    frontmatter_body,
    frontmatter_field,
    frontmatter_raw,
    one_of,
    strip,
)

# Pack size, size above which a section is packed.
CHUNK_TARGET = 1500
CHUNK_MAX = 3000

# Fixed value: a markdown heading, `.` and `$` stopping at \n only and \s
# covering Unicode white space.
HEADING = r"(?mdU)^(#{1,6})\s+(.+)$"

# Element kinds whose body is indexed.
CODE_KINDS = ("function", "method", "class", "struct")


def embed_text(title: Column, heading: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")), content)


def with_sections(docs: DataFrame, packed: bool = False) -> DataFrame:
    """Add title, body and the heading sections of each document; ``_packs`` of long ones if ``packed``.

    ``lead`` is the text before the first heading.  ``sections`` holds, per
    heading, its breadcrumb, start, content start, section end and the start of
    its stripped content (0-based offsets in ``body``), and that content.
    Everything stays inside the row: no text is shuffled.  What Python makes of a
    row needs nothing else that Python made of it, so one worker a task does all.
    """
    raw = frontmatter_raw(F.col("text"))
    split = (
        docs.withColumn("_raw", raw)
        .withColumn("title", F.coalesce(frontmatter_field(F.col("_raw"), "title"), F.lit("")))
        .withColumn("body", frontmatter_body(F.col("text")))
        .withColumn("_heads", F.regexp_extract_all("body", F.lit(HEADING), F.lit(0)))
        .withColumn("_rest", F.split("body", HEADING, -1))
        .withColumn("lead", F.get("_rest", F.lit(0)))
    )

    def under(whole: Column, newline: Column) -> Column:
        return F.when(newline > 0, F.substring(whole, newline + 1, F.length(whole))).otherwise("")

    facts = F.transform(
        F.arrays_zip(
            F.col("_heads").alias("head"),
            F.slice("_rest", F.lit(2), F.greatest(F.size("_rest") - 1, F.lit(0))).alias("rest"),
        ),
        lambda z: one_of(
            F.concat(z["head"], z["rest"]),
            lambda whole: one_of(
                F.locate("\n", whole),
                lambda newline: F.struct(
                    (F.length(z["head"]) - F.length(F.ltrim(z["head"], F.lit("#")))).alias("level"),
                    strip(F.ltrim(z["head"], F.lit("#"))).alias("label"),
                    F.length(whole).alias("width"),
                    F.when(newline > 0, newline).otherwise(F.length(whole) + 1).alias("skip"),
                    (F.length(under(whole, newline)) - F.length(F.ltrim(under(whole, newline), F.lit(WHITESPACE)))).alias("indent"),
                    strip(under(whole, newline)).alias("content"),
                ),
            ),
        ),
    )
    made = {
        "_paths": breadcrumbs(F.transform("_facts", lambda f: f.level), F.transform("_facts", lambda f: f.label)),
        "_starts": section_starts(F.length("lead"), F.transform("_facts", lambda f: f.width)),
    }
    if packed:
        long = F.transform("_facts", lambda f: F.when(F.length(f.content) > CHUNK_MAX, f.content))
        made["_packs"] = pack_each(long, CHUNK_TARGET)
    return (
        split.withColumn("_facts", facts)
        .withColumns(made)
        .withColumn(
            "sections",
            F.transform(
                F.arrays_zip(
                    F.col("_facts").alias("f"), F.col("_paths").alias("p"), F.col("_starts").alias("s")
                ),
                lambda z: F.struct(
                    z["p"].alias("heading"),
                    z["f"].level.alias("level"),
                    z["s"].alias("pos"),
                    (z["s"] + z["f"].skip).alias("content_start"),
                    (z["s"] + z["f"].width).alias("section_end"),
                    (z["s"] + z["f"].skip + z["f"].indent).alias("text_start"),
                    z["f"].content.alias("content"),
                ),
            ),
        )
        .drop("_raw", "_heads", "_rest", "_facts", "_paths", "_starts")
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def breadcrumbs(levels: pa.Array, labels: pa.Array) -> pa.Array:
    """Labels of each heading's open ancestors and its own, joined."""
    made = []
    for row_levels, row_labels in zip(levels.to_pylist(), labels.to_pylist()):
        stack: list[tuple[int, str]] = []
        paths = []
        for level, label in zip(row_levels or (), row_labels or ()):
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, label))
            paths.append(" > ".join(name for _, name in stack))
        made.append(paths)
    return pa.array(made, pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def section_starts(lead: pa.Array, widths: pa.Array) -> pa.Array:
    """Running sums: where each section starts."""
    made = []
    for at, row in zip(lead.to_pylist(), widths.to_pylist()):
        starts = []
        for width in row or ():
            starts.append(at)
            at += width
        made.append(starts)
    return pa.array(made, pa.list_(pa.int32()))


def _chunk(heading: Column, content: Column, start: Column, end: Column) -> Column:
    return F.struct(
        heading.alias("heading"),
        content.alias("content"),
        start.cast("int").alias("char_start"),
        end.cast("int").alias("char_end"),
    )


def _section_chunks(section: Column, packs: Column) -> Column:
    whole = _chunk(section.heading, section.content, section.content_start, section.section_end)
    return (
        F.when(section.content == "", F.array().cast(_CHUNKS))
        .when(
            F.length(section.content) > CHUNK_MAX,
            F.transform(
                packs,
                lambda pack, j: _chunk(
                    F.when(
                        F.size(packs) > 1,
                        F.concat(section.heading, F.lit(" (part "), (j + 1).cast("string"), F.lit(")")),
                    ).otherwise(section.heading),
                    pack.content,
                    section.text_start + pack.start,
                    section.text_start + pack.end,
                ),
            ),
        )
        .otherwise(F.array(whole))
    )


_CHUNKS = "array<struct<heading:string,content:string,char_start:int,char_end:int>>"


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """``(doc_type, path, text)`` to chunks, one row per chunk in document order."""
    lead = strip(F.col("lead"))
    whole = strip(F.col("body"))
    none = F.array().cast(_CHUNKS)
    pieces = F.when(
        F.size("sections") == 0,
        F.when(
            whole != "", F.array(_chunk(F.lit(""), whole, F.lit(0), F.length("body")))
        ).otherwise(none),
    ).otherwise(
        F.concat(
            F.when(
                lead != "", F.array(_chunk(F.lit(""), lead, F.lit(0), F.length("lead")))
            ).otherwise(none),
            F.flatten(
                F.transform(
                    F.arrays_zip(F.col("sections").alias("s"), F.col("_packs").alias("packs")),
                    lambda z: _section_chunks(z["s"], z["packs"]),
                )
            ),
        )
    )
    return (
        with_sections(docs, packed=True)
        .select("doc_type", "path", "title", F.posexplode(pieces).alias("chunk_ord", "c"))
        .select(
            "doc_type",
            "path",
            "title",
            "chunk_ord",
            "c.*",
            embed_text(F.col("title"), F.col("c.heading"), F.col("c.content")).alias("embed_text"),
        )
    )


def kb_documents(docs: DataFrame) -> DataFrame:
    """``(doc_type, path, text)`` to the document table."""
    title = frontmatter_field(frontmatter_raw(F.col("text")), "title")
    return docs.select(
        "doc_type",
        "path",
        F.coalesce(title, F.lit("")).alias("title"),
        content_hash(F.col("text")).alias("content_hash"),
    )


def chunk_code(elements: DataFrame) -> DataFrame:
    """Elements to code chunks; ``char_start`` and ``char_end`` hold line numbers."""
    return elements.where(F.col("kind").isin(*CODE_KINDS) & (F.col("body") != "")).select(
        F.lit("code").alias("doc_type"),
        "path",
        F.lit("").alias("title"),
        F.col("elem_ord").alias("chunk_ord"),
        F.col("scope_path").alias("heading"),
        F.col("body").alias("content"),
        F.col("line_start").alias("char_start"),
        F.col("line_end").alias("char_end"),
        F.concat(
            F.col("path"), F.lit(" > "), F.col("scope_path"), F.lit("\n"), F.col("body")
        ).alias("embed_text"),
    )


def code_documents(chunks: DataFrame) -> DataFrame:
    """One document per file; its hash is that of the file's first chunk."""
    return (
        chunks.withColumn("h", content_hash(F.col("content")))
        .groupBy("doc_type", "path")
        .agg(F.min_by("h", "chunk_ord").alias("content_hash"))
        .select("doc_type", "path", F.lit("").alias("title"), "content_hash")
    )
