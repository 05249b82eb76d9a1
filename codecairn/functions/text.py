"""Column expressions for text: trimming, hashing, paths, frontmatter, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Length of a content hash, frontmatter fence.
HASH_LENGTH = 12
FENCE = "---"


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def one_of(value: Column, build) -> Column:
    """Bind ``value`` once inside a larger expression and build on it."""
    return F.element_at(F.transform(F.array(value), build), 1)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, HASH_LENGTH)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


# -- paths ------------------------------------------------------------------

def path_key(path: Column) -> Column:
    """Sort key giving component-by-component path order."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part of a relative path; ``.`` for a file at the root."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut < 0, F.lit(".")).otherwise(F.substring(path, F.lit(1), cut))


def suffix(path: Column) -> Column:
    """Extension with its dot, case kept; empty when the name has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def module_file_name(directory: Column) -> Column:
    """File-safe name of a module; the root module is ``_root``."""
    return F.when(directory == ".", F.lit("_root")).otherwise(F.translate(directory, "/\\", "__"))


def flow_file_name(flow: Column) -> Column:
    return F.concat(F.lit("flow-"), F.replace(F.lower(flow), F.lit(" "), F.lit("-")))


# -- frontmatter ------------------------------------------------------------

def _fence_end(text: Column) -> Column:
    """1-based position of the closing fence, 0 when the text has no frontmatter."""
    return F.when(F.startswith(text, F.lit(FENCE)), F.locate(FENCE, text, 4)).otherwise(0)


def frontmatter_raw(text: Column) -> Column:
    """Stripped text between the fences, null without frontmatter."""
    end = _fence_end(text)
    return F.when(end > 0, strip(F.substring(text, F.lit(4), end - 4)))


def frontmatter_body(text: Column) -> Column:
    """Stripped body after the fences, or the untouched text without frontmatter."""
    end = _fence_end(text)
    return F.when(end > 0, strip(F.substring(text, end + 3, F.length(text)))).otherwise(text)


def frontmatter_field(raw: Column, field: str) -> Column:
    """Top-level scalar of frontmatter written by our renderers; empty when absent."""
    value = strip(F.regexp_extract(raw, rf"(?m)^{field}:[ \t]*(.*)$", 1))
    return F.coalesce(F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2"), F.lit(""))


def frontmatter_scalars(text: Column) -> Column:
    """Map of every ``key: value`` line of the frontmatter, later lines winning.

    Lines are stripped first, so entries of a nested mapping show up as keys.
    """
    lines = F.split(F.coalesce(frontmatter_raw(text), F.lit("")), "\n")
    pairs = F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            strip(F.substring_index(strip(line), ":", 1)).alias("key"),
            strip(strip(_after_colon(strip(line))), '"').alias("value"),
        ),
    )
    return one_of(pairs, lambda p: F.map_from_entries(last_by_key(p, "key")))


def frontmatter_sources(text: Column) -> Column:
    """Array of (path, hash) listed under ``sources:``; a repeated path keeps its last hash.

    Entries are the indented ``path: hash`` lines right below; work is in
    proportion to the lines (times their logarithm, for repeated paths).
    """
    lines = F.split(F.coalesce(frontmatter_raw(text), F.lit("")), "\n")

    def block(all_lines: Column) -> Column:
        opens = F.array_position(F.transform(all_lines, lambda s: F.startswith(s, F.lit("sources:"))), True)
        return F.when(
            opens > 0, F.slice(all_lines, opens.cast("int") + 1, F.size(all_lines))
        ).otherwise(F.array().cast("array<string>"))

    def leading_entries(below: Column) -> Column:
        is_entry = F.transform(
            below, lambda s: F.startswith(s, F.lit("  ")) & F.contains(F.substring(s, 3, 1 << 30), F.lit(":"))
        )
        stop = F.array_position(is_entry, False).cast("int")
        return F.when(stop > 0, F.slice(below, F.lit(1), stop - 1)).otherwise(below)

    entries = F.transform(
        one_of(one_of(lines, block), leading_entries),
        lambda line: F.struct(
            strip(F.substring_index(strip(line), ":", 1)).alias("path"),
            strip(_after_colon(strip(line))).alias("hash"),
        ),
    )
    return one_of(entries, lambda e: last_by_key(e, "path"))


def _after_colon(line: Column) -> Column:
    return F.substring(line, F.locate(":", line) + 1, F.length(line))


def last_by_key(entries: Column, key: str) -> Column:
    """Keep, of an array of structs, the last entry per ``key`` field, in the order of the array."""
    keyed = F.array_sort(
        F.transform(
            entries, lambda e, i: F.struct(e.getField(key).alias("k"), i.alias("i"), e.alias("entry"))
        )
    )

    def last_of_each(rows: Column) -> Column:
        return F.filter(
            rows, lambda r, j: F.coalesce(~F.get(rows, j + 1).k.eqNullSafe(r.k), F.lit(True)) | (j == F.size(rows) - 1)
        )

    back = F.array_sort(
        F.transform(one_of(keyed, last_of_each), lambda r: F.struct(r.i.alias("i"), r.entry.alias("entry")))
    )
    return F.transform(back, lambda r: r.entry)


def drop_title_line(body: Column) -> Column:
    """Body without a leading ``# `` line, as articles are reused in prompts."""
    newline = F.locate("\n", body)
    return F.when(
        F.startswith(body, F.lit("# ")) & (newline > 0),
        strip(F.substring(body, newline, F.length(body))),
    ).otherwise(body)


# -- sections of a description ---------------------------------------------

def extract_section(markdown: Column, symbol: Column) -> Column:
    """Section whose heading names ``symbol``, null when there is none.

    An exact heading match (either the ``A > b`` or the ``A.b`` spelling) wins
    over the first heading that merely contains the symbol.  The section ends
    before the next heading of the same or a higher rank.
    """
    lines = F.transform(
        F.split(markdown, "\n"),
        lambda line: one_of(
            F.length(line) - F.length(F.ltrim(line, F.lit("#"))),
            lambda level: F.struct(
                line.alias("line"),
                level.alias("level"),
                F.when(
                    level > 0,
                    strip(strip(strip(F.substring(line, level + 1, F.length(line))), "`")),
                ).alias("title"),
            ),
        ),
    )
    scope = F.replace(symbol, F.lit("."), F.lit(" > "))

    def heading_scope(title: Column) -> Column:
        # "## `Scope` — `signature`" starts with the scope up to the next backtick
        return F.substring_index(title, "`", 1)

    def body(rows: Column) -> Column:
        exact = F.array_position(
            F.transform(
                rows,
                lambda r: (r.level > 0)
                & (heading_scope(r.title).isin(symbol, scope) | r.title.isin(symbol, scope)),
            ),
            True,
        )
        loose = F.array_position(
            F.transform(rows, lambda r: (r.level > 0) & F.contains(r.title, symbol)), True
        )
        start = F.when(exact > 0, exact).otherwise(loose).cast("int")
        return one_of(
            start,
            lambda s: F.when(
                s > 0,
                strip(F.array_join(_until_rank(rows, s), "\n")),
            ),
        )

    return one_of(lines, body)


def _until_rank(rows: Column, start: Column) -> Column:
    level = F.element_at(rows, start).level
    tail = F.slice(rows, start + 1, F.size(rows))
    stop = F.array_position(
        F.transform(tail, lambda r: (r.level > 0) & (r.level <= level)), True
    ).cast("int")
    kept = F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail)
    return F.concat(
        F.array(F.element_at(rows, start).line), F.transform(kept, lambda r: r.line)
    )
