"""Structure and call graph of source files.

``parse_files`` reads every file once; everything else is derived from its
facts.  The call graph as tables is made in ``wiring``; ``file_graphs`` gives a
file's functions in its own row, for prompts and files written per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecairn.functions.lookup import last_positions, running_starts
from codecairn.functions.pyfacts import COUNTS, PIECES, parse_column, parse_pieces
from codecairn.session import keyed, materialize

# Names treated as builtins when called bare.
BUILTINS = (
    "abs", "all", "any", "ascii", "bin", "bool", "breakpoint", "bytearray", "bytes", "callable", "chr",
    "classmethod", "compile", "complex", "delattr", "dict", "dir", "divmod", "enumerate", "eval", "exec",
    "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr", "hash", "help", "hex", "id",
    "input", "int", "isinstance", "issubclass", "iter", "len", "list", "locals", "map", "max", "memoryview",
    "min", "next", "object", "oct", "open", "ord", "pow", "print", "property", "range", "repr", "reversed",
    "round", "set", "setattr", "slice", "sorted", "staticmethod", "str", "sum", "super", "tuple", "type",
    "vars", "zip",
)

# Kinds that define a callable or class name.
FUNCTION_KINDS = ("function", "method")
DEFINITION_KINDS = ("function", "method", "class")


def parse_files(files: DataFrame) -> DataFrame:
    """Add ``facts`` to ``(path, content, …)``.

    Filter the files first: a predicate above the parse is not pushed below it.
    """
    return files.withColumn("facts", parse_column(F.col("content")))


def parse_long_files(files: DataFrame, text: bool = True) -> DataFrame:
    """``(path, content, facts, before)``: a row per piece of a file, with the piece as its content.

    ``files`` has ``path, section, content``: a file lies in one row, ``section``
    null, or in sections, in that order, of whole top-level statements.  A long
    row is read in pieces as well.  ``before`` counts the lines, elements,
    functions and bound names of the pieces before, which ``elements`` and
    ``wire`` number theirs on from.  A file does not parse if a section of it
    does not, and then has no rows.  Without ``text`` the content, which ``wire``
    does not read, is left out.

    Only pieces of files in several are counted, so the counts, one row per
    section or ``PIECE`` bytes, are few beside the files and may be broadcast.
    """
    pieces = materialize(files.select("path", "section", "content").mapInArrow(parse_pieces(text), PIECES))
    parts = pieces.where(F.col("counts").isNotNull()).select(
        "path", "section", "piece", "counts", F.col("facts.error").isNotNull().alias("error")
    )
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("section", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.struct(*(F.coalesce(F.sum(f"counts.{c}").over(earlier), F.lit(0)).cast("int").alias(c) for c in COUNTS))
    numbered = parts.select(
        F.col("path").alias("_path"), F.col("section").alias("_section"), F.col("piece").alias("_piece"),
        before.alias("before"), F.max("error").over(whole).alias("broken"),
    )
    same = (F.col("path") == F.col("_path")) & F.col("section").eqNullSafe(F.col("_section")) & (F.col("piece") == F.col("_piece"))
    known = pieces.join(numbered, same, "left").where(~F.coalesce("broken", F.lit(False)))
    return known.select("path", *(["content"] if text else []), "facts", "before")


def before(parsed: DataFrame, count: str) -> Column:
    """How many of ``COUNTS`` a file has before the piece of this row."""
    return F.coalesce(F.col(f"before.{count}"), F.lit(0)) if "before" in parsed.columns else F.lit(0)


def _slice_text(content: Column, start: Column, length: Column) -> Column:
    return F.substring(content, start + 1, length).cast("string")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("facts.error").isNotNull()).select(
        "path", F.col("facts.error").alias("parse_error")
    )


def elements(parsed: DataFrame) -> DataFrame:
    """Flattened structural elements, pre-order, with their source text."""
    lines, numbers = before(parsed, "lines").alias("_lines"), before(parsed, "elements").alias("_elements")
    return parsed.select("path", "content", lines, numbers, F.inline("facts.elements")).select(
        "path",
        (F.col("elem_ord") + F.col("_elements")).alias("elem_ord"),
        (F.col("parent_ord") + F.col("_elements")).alias("parent_ord"),
        "depth",
        "kind",
        "name",
        "scope_path",
        "signature",
        "decorators",
        "docstring",
        _slice_text(F.col("content"), F.col("start"), F.col("length")).alias("body"),
        (F.col("line_start") + F.col("_lines")).alias("line_start"),
        (F.col("line_end") + F.col("_lines")).alias("line_end"),
    )


def raw_imports(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "path", "content", F.posexplode("facts.imports").alias("import_ord", "i")
    ).select(
        "path",
        "import_ord",
        _slice_text(F.col("content"), F.col("i.start"), F.col("i.length")).alias("raw"),
        F.lit(None).cast("string").alias("resolved_path"),
    )


def graph_imports(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "path", F.posexplode("facts.graph_imports").alias("import_ord", "i")
    ).select("path", "import_ord", "i.*")


def import_names(imports: Column) -> Column:
    """Array of (name, module) an import list brings into scope, in order.

    ``import a.b`` binds ``a``, an alias binds itself, ``from m import x as y``
    binds ``x``, a star binds nothing.
    """

    def one(i: Column) -> Column:
        named = F.transform(
            F.filter(i.names, lambda n: n != "*"),
            lambda n: F.struct(n.alias("name"), i.module.alias("module")),
        )
        whole = F.array(
            F.struct(
                F.coalesce(i.getField("alias"), F.substring_index(i.module, ".", 1)).alias("name"),
                i.module.alias("module"),
            )
        )
        return F.when(F.size(i.names) > 0, named).otherwise(whole)

    return F.flatten(F.transform(imports, one))


def qualified(scope: Column, name: Column) -> Column:
    return F.concat_ws(".", scope, name)


def file_graphs(parsed: DataFrame, *keep: str) -> DataFrame:
    """``(path, keep…, functions)``: the functions of a file with their resolved calls.

    Calls are distinct, in order, builtins dropped.  A call is resolved, first
    match wins: ``self.x`` to the enclosing class; a dotted name to the import
    of its first part or to nothing; a bare name to a builtin (dropped), a
    definition of the file, an import, or nothing.
    """
    scoped = parsed.select(
        "path",
        *keep,
        F.col("facts.elements").alias("_elements"),
        import_names(F.col("facts.graph_imports")).alias("_bound"),
        F.transform(
            F.filter("facts.elements", lambda e: e.kind.isin(*DEFINITION_KINDS)),
            lambda e: e["name"],
        ).alias("_defined"),
    )

    own = F.filter("_elements", lambda e: e.kind.isin(*FUNCTION_KINDS))
    called = scoped.withColumn("_own", own).withColumn(
        "_kept",
        F.transform(
            "_own", lambda e: F.filter(F.array_distinct(e.raw_calls), lambda raw: ~raw.isin(*BUILTINS))
        ),
    )
    # the calls of all functions end to end, each looked up once; the last binding of a name wins
    flat = F.flatten("_kept")
    first_part = F.transform(flat, lambda raw: F.substring_index(raw, ".", 1))
    found = called.withColumns(
        {
            "_import_at": last_positions(first_part, F.transform("_bound", lambda b: b["name"])),
            "_defined_at": last_positions(flat, F.col("_defined")),
            "_start": running_starts(F.transform("_kept", lambda k: F.size(k))),
        }
    )

    def resolve(raw: Column, class_name: Column, at: Column) -> Column:
        own = F.startswith(raw, F.lit("self."))
        method = F.substring(raw, F.lit(6), F.length(raw))
        local = ~F.contains(raw, F.lit(".")) & F.get("_defined_at", at).isNotNull()
        return F.struct(
            F.when(own & class_name.isNotNull(), F.concat_ws(".", class_name, method))
            .otherwise(raw)
            .alias("name"),
            F.when(own, F.lit("self"))
            .when(local, F.lit("local"))
            .otherwise(F.get("_bound", F.get("_import_at", at)).module)
            .alias("resolved"),
        )

    def function(e: Column, i: Column) -> Column:
        return F.struct(
            i.alias("fn_ord"),
            e["name"].alias("name"),
            e.class_name.alias("scope"),
            qualified(e.class_name, e["name"]).alias("qualified_name"),
            F.transform(
                F.get("_kept", i), lambda raw, j: resolve(raw, e.class_name, F.get("_start", i) + j)
            ).alias("calls"),
        )

    return found.select("path", *keep, F.transform("_own", function).alias("functions"))


def _same_file(resolved: Column) -> Column:
    return F.coalesce(resolved.isin("local", "self"), F.lit(False))


def caller_edges(call_rows: DataFrame) -> DataFrame:
    """Inverted edges of same-file calls, dangling callees included.

    Edges of one callee are ordered by ``(fn_ord, call_ord)``.
    """
    return call_rows.where(F.col("resolved").isin("local", "self")).select(
        "path", F.col("name").alias("callee"), "caller", "fn_ord", "call_ord"
    )


def edge_count(call_rows: DataFrame) -> DataFrame:
    return caller_edges(call_rows).agg(F.count("*").alias("edges"))


def inner_edges(functions: Column) -> Column:
    """``(callee, caller)`` of every call that stays in the file, in order."""
    return F.flatten(
        F.transform(
            functions,
            lambda f: F.transform(
                F.filter(f.calls, lambda c: _same_file(c.resolved)),
                lambda c: F.struct(c["name"].alias("callee"), f.qualified_name.alias("caller")),
            ),
        )
    )


def function_stats_from_tables(fns: DataFrame, call_rows: DataFrame) -> DataFrame:
    """The same counts from stored ``functions`` and ``calls`` tables.

    Both sides are counted per key before they meet, so the joins see one row
    per function or callee however often it is called.
    """
    made = call_rows.groupBy("path", "fn_ord").agg(F.count("*").alias("calls_count"))
    received = (
        caller_edges(call_rows)
        .groupBy("path", F.col("callee").alias("qualified_name"))
        .agg(F.count("*").alias("callers_count"))
    )
    return (
        fns.join(keyed(made), ["path", "fn_ord"], "left")
        .join(keyed(received), ["path", "qualified_name"], "left")
        .select(
            "path",
            "fn_ord",
            "qualified_name",
            F.coalesce("calls_count", F.lit(0)).alias("calls_count"),
            F.coalesce("callers_count", F.lit(0)).alias("callers_count"),
        )
    )


def file_stats(fn_stats: DataFrame) -> DataFrame:
    return fn_stats.groupBy("path").agg(
        F.count("*").alias("functions"),
        F.sum("callers_count").alias("total_callers"),
        F.sum("calls_count").alias("total_calls"),
    )


def callers_of(edges: DataFrame, path: str, name: str) -> DataFrame:
    return (
        edges.where((F.col("path") == path) & (F.col("callee") == name))
        .orderBy("fn_ord", "call_ord")
        .select(F.col("path").alias("file"), F.col("caller").alias("function"))
    )


def callees_of(fns: DataFrame, call_rows: DataFrame, path: str, name: str) -> DataFrame:
    """Calls of the first function of that name in the file."""
    named = fns.where((F.col("path") == path) & (F.col("qualified_name") == name))
    first = named.agg(F.min("fn_ord").alias("fn_ord"))  # one row, so it is broadcast
    mine = call_rows.where((F.col("path") == path) & (F.col("caller") == name))
    return mine.join(F.broadcast(first), "fn_ord").orderBy("call_ord").select("name", "resolved")
