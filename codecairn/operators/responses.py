"""Reading generated text, matching it to elements, rendering the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecairn.functions.text import strip

# Bounds and step of the answer length asked for.
TOKENS_PER_ELEMENT = 100
MIN_TOKENS = 4096
MAX_TOKENS = 16384

# A symbol heading of an answer; markup removed from a flow line;
# markup around a flow name.
SYMBOL_HEADING = r"(?md)^### (.*)$"
FLOW_MARKUP = r"(?sU)^(.*?)[*_`#\d.)\-]+\s*(.*)$"
FLOW_QUOTES = "*_`"


def max_tokens(n_elements: Column) -> Column:
    return F.least(
        F.greatest(n_elements * TOKENS_PER_ELEMENT, F.lit(MIN_TOKENS)), F.lit(MAX_TOKENS)
    )


def response_summary(response: Column) -> Column:
    """Text before the first symbol heading."""
    return strip(F.get(F.split(response, SYMBOL_HEADING, -1), F.lit(0)))


def response_symbols(responses: DataFrame) -> DataFrame:
    """``(path, response)`` to described symbols; blank descriptions are dropped."""
    parts = F.arrays_zip(
        F.regexp_extract_all("response", F.lit(SYMBOL_HEADING), F.lit(1)).alias("head"),
        F.slice(F.split("response", SYMBOL_HEADING, -1), 2, 1_000_000_000).alias("text"),
    )
    symbols = F.transform(
        parts,
        lambda p: F.struct(
            strip(strip(strip(p["head"]), "`")).alias("scope_path"),
            strip(p["text"]).alias("description"),
        ),
    )
    return (
        responses.select(
            *[c for c in responses.columns if c != "response"],
            F.posexplode(F.filter(symbols, lambda s: s.description != "")).alias("sym_ord", "s"),
        )
        .select("*", "s.*")
        .drop("s")
    )


def element_map(elements: DataFrame) -> DataFrame:
    """One element per (path, scope); a later duplicate replaces the facts of an
    earlier one but keeps its place in the order."""
    facts = F.struct("kind", "signature", "line_start", "line_end")
    return (
        elements.groupBy("path", "scope_path")
        .agg(F.max_by(facts, "elem_ord").alias("e"), F.min("elem_ord").alias("elem_ord"))
        .select("path", "scope_path", "elem_ord", "e.*")
    )


def match_symbols(symbols: DataFrame, elements: DataFrame) -> DataFrame:
    """Described symbols with the facts of their element; ``unknown`` without one."""
    joined = symbols.join(element_map(elements).drop("elem_ord"), ["path", "scope_path"], "left")
    return joined.withColumns(
        {
            "kind": F.coalesce("kind", F.lit("unknown")),
            "line_start": F.coalesce("line_start", F.lit(0)),
            "line_end": F.coalesce("line_end", F.lit(0)),
        }
    )


def missing_elements(elements: DataFrame, symbols: DataFrame) -> DataFrame:
    """Elements of the described files that no symbol names."""
    return element_map(elements).join(symbols, ["path", "scope_path"], "left_anti")


def element_counts(elements: DataFrame) -> DataFrame:
    return (
        elements.groupBy("path")
        .agg(F.count("*").alias("n_elements"))
        .withColumn("max_tokens", max_tokens(F.col("n_elements")))
    )


# -- flows and verdicts -------------------------------------------------------

def flows(response: Column) -> Column:
    """Array of (name, description): a FLOW line paired with the next TRACE line.

    The first run of list or emphasis markup of a line is removed wherever it
    stands, so ``FLOW: Top-K`` reads ``TopK``.
    """
    cleaned = F.transform(
        F.split(response, "\n"),
        lambda line: strip(F.regexp_replace(strip(line), FLOW_MARKUP, "$1$2")),
    )
    start = F.struct(
        F.lit("").alias("name"),
        F.array().cast("array<struct<name:string,description:string>>").alias("out"),
    )

    def label(line: Column, word: str) -> Column:
        return F.upper(F.substring(line, 1, len(word))) == word

    def value(line: Column, word: str) -> Column:
        return strip(strip(F.substring(line, F.lit(len(word) + 1), F.length(line))), FLOW_QUOTES)

    def step(acc: Column, line: Column) -> Column:
        named = label(line, "FLOW:")
        traced = ~named & label(line, "TRACE:") & (acc["name"] != "")
        found = F.struct(acc["name"].alias("name"), value(line, "TRACE:").alias("description"))
        return F.struct(
            F.when(named, value(line, "FLOW:"))
            .when(traced, F.lit(""))
            .otherwise(acc["name"])
            .alias("name"),
            F.when(traced, F.array_append(acc.out, found)).otherwise(acc.out).alias("out"),
        )

    return F.aggregate(cleaned, start, step, lambda acc: acc.out)


def verdict(response: Column) -> Column:
    """Whether the first VERDICT line says yes; true when there is none."""
    lines = F.transform(F.split(strip(response), "\n"), lambda line: F.upper(strip(line)))
    said = F.filter(lines, lambda line: F.startswith(line, F.lit("VERDICT:")))
    return F.coalesce(F.contains(F.get(said, F.lit(0)), F.lit("YES")), F.lit(True))


# -- rendering ----------------------------------------------------------------

def _line(label: str, value: Column) -> Column:
    """Frontmatter line, null (so left out) when the value is empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def symbol_list(symbols: DataFrame) -> DataFrame:
    """Symbols of a file as one ordered array; limited by what one answer can hold."""
    item = F.struct(
        "sym_ord", "scope_path", "kind", "signature", "description", "line_start", "line_end"
    )
    return symbols.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("symbols"))


def description_markdown(
    path: Column, summary: Column, symbols: Column, source_hash: Column, commit: Column, model: Column
) -> Column:
    def listed(s: Column) -> Column:
        return F.format_string(
            '  - scope_path: "%s"\n    kind: %s\n    lines: %d-%d',
            s.scope_path, s.kind, s.line_start, s.line_end,
        )

    def section(s: Column) -> Column:
        signature = F.when(
            F.coalesce(s.signature, F.lit("")) != "",
            F.concat(F.lit(" — `"), s.signature, F.lit("`")),
        ).otherwise("")
        return F.concat(
            F.lit("## `"), s.scope_path, F.lit("`"), signature, F.lit("\n\n"), s.description,
            F.lit("\n"),
        )

    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("source: "), path),
        _line("source_hash: ", source_hash),
        _line("commit: ", commit),
        _line("model: ", model),
        F.when(
            F.size(symbols) > 0,
            F.concat(F.lit("symbols:\n"), F.array_join(F.transform(symbols, listed), "\n")),
        ),
        F.lit("---\n"),
        F.concat(F.lit("# "), path, F.lit("\n")),
        F.concat(summary, F.lit("\n")),
        F.when(F.size(symbols) > 0, F.array_join(F.transform(symbols, section), "\n")),
    )


def article_markdown(
    title: Column,
    content: Column,
    article_type: Column,
    sources: Column,
    model: Column,
    commit: Column,
    commit_dirty: Column,
) -> Column:
    """Article with frontmatter; ``sources`` is an array of (path, hash)."""
    listed = F.transform(
        sources, lambda s: F.concat(F.lit("  "), s.path, F.lit(": "), s.getField("hash"))
    )
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), title, F.lit('"')),
        F.concat(F.lit("type: "), article_type),
        _line("model: ", model),
        _line("commit: ", commit),
        F.when(commit_dirty, F.lit("commit_dirty: true")),
        F.when(F.size(sources) > 0, F.concat(F.lit("sources:\n"), F.array_join(listed, "\n"))),
        F.lit("---\n"),
        F.concat(F.lit("# "), title, F.lit("\n")),
        F.concat(content, F.lit("\n")),
    )


def element_bullet(depth: Column, scope: Column, kind: Column, signature: Column) -> Column:
    """Indented bullet naming an element in a prompt."""
    tail = F.when(
        F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(" — `"), signature, F.lit("`"))
    ).otherwise("")
    return F.concat(
        F.repeat(F.lit("  "), depth), F.lit("- **"), scope, F.lit("** ("), kind, F.lit(")"), tail
    )


def skeleton_line(depth: Column, name: Column, signature: Column, docstring: Column) -> Column:
    doc = F.when(
        F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit('  """'), docstring, F.lit('"""'))
    ).otherwise("")
    return F.concat(
        F.repeat(F.lit("  "), depth), F.coalesce(F.nullif(signature, F.lit("")), name), doc
    )


def file_skeletons(parsed: DataFrame) -> DataFrame:
    """``(path, skeleton)``: imports, a blank line, then one line per element.

    Built from the facts of the row, so nothing is shuffled.  The project
    skeleton is these rows in path order, each under its own heading.
    """
    source = F.col("content")
    imports = F.transform(
        "facts.imports",
        lambda i: F.substring(source, i.start + 1, i.length).cast("string"),
    )
    lines = F.transform(
        "facts.elements", lambda e: skeleton_line(e.depth, e["name"], e.signature, e.docstring)
    )
    head = F.when(F.size(imports) > 0, F.concat(imports, F.array(F.lit(""))))
    everything = F.concat(F.coalesce(head, F.array().cast("array<string>")), lines)
    return parsed.select("path", F.array_join(everything, "\n").alias("skeleton"))


def skeleton_block(path: Column, skeleton: Column) -> Column:
    return F.concat(F.lit("### "), path, F.lit("\n```\n"), skeleton, F.lit("\n```\n"))


