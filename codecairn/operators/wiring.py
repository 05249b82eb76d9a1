"""The call graph as keyed tables.

``cut`` turns the facts of a file into narrow rows, one per function, call and
name, so that nothing of the file but its path travels with a row.  What a call
means is then a matter of two joins on (path, name): with the names the file
binds and defines, and with the functions it has.  A file of very many functions
spreads over tasks by name; the joins read plain tables on both sides, so that
adaptive execution can split a name that a file calls very often.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecairn.operators.graph import (
    BUILTINS,
    DEFINITION_KINDS,
    FUNCTION_KINDS,
    before,
    caller_edges,
    function_stats_from_tables,
    import_names,
    qualified,
)
from codecairn.session import keyed, materialize


@dataclass
class Wiring:
    """``functions`` and ``calls`` of files, as tables."""

    functions: DataFrame
    calls: DataFrame

    def stats(self) -> DataFrame:
        """Calls and callers per function, same-named functions sharing their callers."""
        counted = function_stats_from_tables(self.functions, self.calls)
        return counted.select("path", "fn_ord", "qualified_name", "calls_count", "callers_count")

    def callers(self) -> DataFrame:
        """``(path, callee, caller)`` of the functions a file defines."""
        return self.calls.where("wired").select("path", F.col("name").alias("callee"), "caller")

    def edges(self) -> DataFrame:
        return caller_edges(self.calls)

    def contexts(self) -> DataFrame:
        """Callers and calls of every function; same-named functions share their callers.

        Both are gathered per function, in order, before they meet it.
        """
        received = (
            self.edges()
            .groupBy("path", F.col("callee").alias("qualified_name"))
            .agg(F.array_sort(F.collect_list(F.struct("fn_ord", "call_ord", "caller"))).alias("callers"))
        )
        made = self.calls.groupBy("path", "fn_ord").agg(
            F.array_sort(F.collect_list(F.struct("call_ord", "name", "resolved"))).alias("calls")
        )
        callers = F.transform("callers", lambda c: c.caller)
        calls = F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c.resolved.alias("resolved")))
        none = F.array().cast("array<struct<name:string,resolved:string>>")
        return (
            self.functions.join(keyed(made), ["path", "fn_ord"], "left")
            .join(keyed(received), ["path", "qualified_name"], "left")
            .select(
                "path",
                "fn_ord",
                "qualified_name",
                F.coalesce(callers, F.array().cast("array<string>")).alias("callers"),
                F.coalesce(calls, none).alias("calls"),
            )
        )


def _row(kind: str, **fields: Column) -> Column:
    names = {"fn_ord": "int", "call_ord": "int", "name": "string", "scope": "string", "key": "string", "module": "string"}
    made = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
    return F.struct(F.lit(kind).alias("kind"), *made)


def cut(parsed: DataFrame) -> DataFrame:
    """``(path, kind, fn_ord, call_ord, name, scope, key, module)`` from ``(path, facts)``.

    ``function``: ``key`` is the qualified name.  ``call``: ``name`` as written,
    ``key`` its first part (null below ``self``), ``module`` the caller; calls of
    a function are distinct, in order, builtins dropped.  ``binding``: ``key``
    and its ``module``, in order of ``fn_ord``.  ``definition``: ``key``.
    Functions and bindings are numbered through all pieces of a file.
    """
    own = F.filter("facts.elements", lambda e: e.kind.isin(*FUNCTION_KINDS))
    defined = F.filter("facts.elements", lambda e: e.kind.isin(*DEFINITION_KINDS))

    first, first_bound = before(parsed, "functions"), before(parsed, "bindings")

    def function(e: Column, i: Column) -> Column:
        return _row("function", fn_ord=first + i, name=e["name"], scope=e.class_name, key=qualified(e.class_name, e["name"]))

    def called(e: Column, i: Column) -> Column:
        kept = F.filter(F.array_distinct(e.raw_calls), lambda raw: ~raw.isin(*BUILTINS))
        return F.transform(
            kept,
            lambda raw, j: _row(
                "call",
                fn_ord=first + i,
                call_ord=j,
                name=raw,
                scope=e.class_name,
                key=F.when(~F.startswith(raw, F.lit("self.")), F.substring_index(raw, ".", 1)),
                module=qualified(e.class_name, e["name"]),
            ),
        )

    rows = F.concat(
        F.transform(own, function),
        F.flatten(F.transform(own, called)),
        F.transform(import_names(F.col("facts.graph_imports")), lambda b, i: _row("binding", fn_ord=first_bound + i, key=b["name"], module=b.module)),
        F.transform(defined, lambda e: _row("definition", key=e["name"])),
    )
    return parsed.select("path", F.inline(rows))


def _names(facts: DataFrame) -> DataFrame:
    """What a file knows under a name: its last binding, a definition, a function."""
    binding = F.col("kind") == "binding"
    return (
        facts.where(F.col("kind") != "call")
        .groupBy("path", "key")
        .agg(
            F.max(F.when(binding, F.struct("fn_ord", "module"))).alias("bound"),
            F.max(F.col("kind") == "definition").alias("defined"),
            F.max(F.col("kind") == "function").alias("is_function"),
        )
        .select("path", "key", F.col("bound.module").alias("module"), "defined", "is_function")
    )


def wire(parsed: DataFrame) -> Wiring:
    """Functions and resolved calls of parsed files, a row of ``parsed`` per file or piece of one.

    A call is resolved, first match wins: ``self.x`` to the enclosing class; a
    dotted name to the import of its first part or to nothing; a bare name to a
    definition of the file, an import, or nothing.  ``wired`` tells whether the
    call names a function of its file.
    """
    facts = materialize(cut(parsed))
    names = materialize(_names(facts))
    functions = facts.where(F.col("kind") == "function").select(
        "path", "fn_ord", "name", "scope", F.col("key").alias("qualified_name")
    )
    calls = facts.where(F.col("kind") == "call").select(
        "path", "fn_ord", F.col("module").alias("caller"), "call_ord", F.col("name").alias("raw"), "scope", "key"
    )
    known = keyed(names.withColumnsRenamed({"path": "_path", "key": "_key"}))
    found = calls.where(F.col("key").isNotNull()).join(
        known, (F.col("path") == F.col("_path")) & (F.col("key") == F.col("_key")), "left"
    )
    local = (F.col("raw") == F.col("key")) & F.coalesce("defined", F.lit(False))
    found = found.select(
        "path", "fn_ord", "caller", "call_ord", F.col("raw").alias("name"),
        F.when(local, F.lit("local")).otherwise(F.col("module")).alias("resolved"),
    )
    method = F.expr("substring(raw, 6)")
    mine = calls.where(F.col("key").isNull()).select(
        "path", "fn_ord", "caller", "call_ord",
        F.when(F.col("scope").isNotNull(), F.concat_ws(".", "scope", method)).otherwise(F.col("raw")).alias("name"),
        F.lit("self").alias("resolved"),
    )
    resolved = found.unionAll(mine)
    inside = F.coalesce(F.col("resolved").isin("local", "self"), F.lit(False))
    # a call that leaves the file cannot name a function of it, and is not looked up
    own = keyed(names.where("is_function").select(F.col("path").alias("_path"), F.col("key").alias("_key")))
    near = resolved.where(inside).join(
        own, (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_key")), "left"
    )
    columns = ("path", "fn_ord", "caller", "call_ord", "name", "resolved")
    calls = near.select(*columns, F.col("_key").isNotNull().alias("wired")).unionAll(
        resolved.where(~inside).select(*columns, F.lit(False).alias("wired"))
    )
    return Wiring(functions, calls)
