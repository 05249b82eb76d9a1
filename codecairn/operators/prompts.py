"""Prompts as projections over ordered aggregates.

The wording is ours; the inputs, their order and the answer format follow the
operator list.  Texts gathered into one prompt are batches of a size limit; what
does not fit into one is summarized in levels (``plans.digest``), never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecairn.functions.lookup import all_positions
from codecairn.functions.text import path_key
from codecairn.operators.budgets import join_neighbor_sets, neighbor_sets
from codecairn.operators.graph import inner_edges
from codecairn.operators.responses import element_bullet, max_tokens, skeleton_block
from codecairn.session import keyed

ANSWER_FORMAT = """
## Answer format

Answer with the following structure only, without a code fence around it.
{lead}Give every listed element a heading made of its exact scope path, then a paragraph:

### `scope_path`

What the element does.

Add no elements that are not listed and do not repeat source code.
"""

ELEMENTS_TASK = (
    "\n## Elements to describe\n"
    "Say for each what it does, what goes in and comes out, and what is notable about it.\n"
)

OVERVIEW_TASK = """Write an architecture document in prose under markdown headings. Cover the
purpose of the project, its components and their duties, how data moves through it, the design
decisions that matter, and the ways it is entered{extra}. Name concrete files, functions and data.
"""

MODULE_TASK = """Summarize the module `%s`: its purpose, its key abstractions, how its files work
together, what it offers to and needs from other modules, and its notable patterns. Name concrete
files, classes and signatures, and be brief.
"""

FLOW_TASK = """Document the %s flow from start to end: where it begins, each step in order, how
data changes, where it branches, and how it ends. Use markdown headings for the phases and name
concrete files and functions.
"""


def _text(value: str) -> Column:
    return F.lit(value)


def file_block(path: Column, language: Column, source: Column) -> Column:
    return F.concat(
        F.lit("### "), path, F.lit("\n```"), language, F.lit("\n"), source, F.lit("\n```\n")
    )


def _project(name: str) -> str:
    return f"`{name}`" if name else "this project"


def file_pieces(files: DataFrame, limit: int) -> DataFrame:
    """``(dir, path, piece, n_pieces, block)``: source blocks of at most ``limit`` source characters.

    A longer file becomes several blocks, each saying which part it is.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("source") - 1, F.lit(0)), F.lit(limit))
    cut = files.select("dir", "path", "language", "source", F.size(starts).alias("n_pieces"), F.posexplode(starts).alias("piece", "at"))
    label = F.when(F.col("n_pieces") == 1, F.col("path")).otherwise(
        F.concat(
            "path", F.lit(" (part "), (F.col("piece") + 1).cast("string"), F.lit(" of "), F.col("n_pieces").cast("string"), F.lit(")")
        )
    )
    return cut.select(
        "dir", "path", "piece", "n_pieces",
        file_block(label, F.col("language"), F.substring(F.col("source"), F.col("at") + 1, F.lit(limit))).alias("block"),
    )


# -- descriptions -------------------------------------------------------------

def with_caller_lines(files: DataFrame) -> DataFrame:
    """Add ``caller_lines``: a line per function that has callers in its file, in order."""
    placed = (
        files.withColumn("_edges", inner_edges(F.col("functions")))
        .withColumn("_names", F.array_distinct(F.transform("functions", lambda f: f.qualified_name)))
        .withColumn("_at", all_positions(F.col("_names"), F.transform("_edges", lambda e: e.callee)))
    )
    listed = F.filter(
        F.arrays_zip(F.col("_names").alias("name"), F.col("_at").alias("at")), lambda z: F.size(z["at"]) > 0
    )
    callers = lambda at: F.transform(
        at,
        lambda i: F.concat(F.lit("`"), F.get("_edges", i).caller, F.lit("` ("), F.col("path"), F.lit(")")),
    )
    lines = F.transform(
        listed,
        lambda z: F.concat(
            F.lit("- `"), z["name"], F.lit("` is called by: "), F.array_join(callers(z["at"]), ", ")
        ),
    )
    return placed.withColumn("caller_lines", lines).drop("_edges", "_names", "_at")


def neighbor_texts(files: DataFrame, work: DataFrame) -> DataFrame:
    """``(dir, for_path, neighbor_text)`` for the directories that have work.

    One text holds at most one neighbour budget of source.  Only paths and
    lengths are compared by directory; source is fetched by path.
    """
    slim = files.select("dir", "path", "n_chars")
    sets = neighbor_sets(slim.join(keyed(work.select("dir").distinct()), "dir", "left_semi"))
    wanted = work.select(F.col("path").alias("for_path"), F.lit(True).alias("_wanted"))
    members = (
        sets.join(keyed(wanted), "for_path", "left")
        .where(F.col("for_path").isNull() | F.col("_wanted"))
        .select("dir", "for_path", F.posexplode_outer("neighbors").alias("pos", "path"))
    )
    blocks = files.select("path", file_block(F.col("path"), F.lit(""), F.col("source")).alias("block"))
    return (
        members.join(keyed(blocks), "path", "left")
        .groupBy("dir", "for_path")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("blocks"))
        .select(
            "dir",
            "for_path",
            F.array_join(F.transform("blocks", lambda b: b.block), "").alias("neighbor_text"),
        )
    )


def describe_prompts(
    work: DataFrame, files: DataFrame, architecture: str | None, project: str
) -> DataFrame:
    """``(path, prompt, max_tokens)`` for the files to describe.

    ``work`` holds parsed files with their ``functions``, ``files`` every file
    of the project (for the neighbours).
    """
    empty = files.where(F.col("n_chars") == 0).select("dir", "path", "n_chars")
    joined = join_neighbor_sets(with_caller_lines(work), neighbor_texts(files, work), F.col("neighbor_text"), empty)
    none = F.array().cast("array<string>")
    bullets = F.transform(
        "facts.elements", lambda e: element_bullet(e.depth, e.scope_path, e.kind, e.signature)
    )
    callers = F.coalesce("caller_lines", none)
    empty = F.col("empty_neighbors")
    neighbors = F.nullif(F.coalesce("neighbor_set", F.lit("")), F.lit(""))
    prompt = F.concat_ws(
        "",
        F.lit("This is the file `"), F.col("path"), _text(f"` of {_project(project)}.\n"),
        _text(f"\n## Architecture\n\n{architecture}\n") if architecture else F.lit(None).cast("string"),
        F.when(
            neighbors.isNotNull() | (empty > 0),
            F.concat_ws(
                "",
                F.lit("\n## Files next to it\n\n"),
                neighbors,
                F.when(empty > 0, F.concat(F.lit("Empty files: "), empty.cast("string"), F.lit("\n"))),
            ),
        ),
        F.lit("\n"), file_block(F.col("path"), F.col("language"), F.col("source")),
        _text(ELEMENTS_TASK), F.array_join(bullets, "\n"), F.lit("\n"),
        F.when(
            F.size(callers) > 0,
            F.concat(F.lit("\n## Known callers\n\n"), F.array_join(callers, "\n"), F.lit("\n")),
        ),
        _text(ANSWER_FORMAT.format(lead="Begin with a paragraph on the duty of the file.\n")),
    )
    return joined.select(
        "path", prompt.alias("prompt"), max_tokens(F.size("facts.elements")).alias("max_tokens")
    )


def continuation_prompts(missing: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """Prompts for the elements an answer left out; a list is limited by its file."""
    bullet = element_bullet(F.lit(0), F.col("scope_path"), F.col("kind"), F.col("signature"))
    listed = missing.groupBy("path").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("elem_ord", bullet.alias("bullet")))).alias("bullets"),
    )
    prompt = F.concat(
        F.lit("This is the file `"), F.col("path"),
        _text(f"` of {_project(project)}. Some of its elements are described already; describe the rest.\n\n"),
        file_block(F.col("path"), F.col("language"), F.col("source")),
        _text(ELEMENTS_TASK), F.array_join(F.transform("bullets", lambda b: b.bullet), "\n"),
        F.lit("\n"), _text(ANSWER_FORMAT.format(lead="")),
    )
    return files.join(listed, "path").select(
        "path", prompt.alias("prompt"), max_tokens(F.col("n")).cast("int").alias("max_tokens")
    )


# -- synthesis ------------------------------------------------------------------

def digest_prompts(batches: DataFrame, subject: Column, project: str) -> DataFrame:
    """``(key, batch, prompt)`` for one level of summaries: ``batches`` has ``key, batch, text``."""
    return batches.select(
        "key",
        "batch",
        F.concat(
            F.lit("Part "), (F.col("batch") + 1).cast("string"), F.lit(" of "), subject,
            _text(f" of {_project(project)} follows.\n\n"), F.col("text"),
            _text("\nSummarize this part so that its summary can stand for it. Keep names of files, classes and functions.\n"),
        ).alias("prompt"),
    )


def skeleton_parts(skeletons: DataFrame) -> DataFrame:
    """``(path, text)``: the outline of each file."""
    return skeletons.select("path", skeleton_block(F.col("path"), F.col("skeleton")).alias("text"))


def architecture_prompt(outline: str, source: str, project: str) -> str:
    """Overview of a project from its outline and source, or from digests of them."""
    return (
        f"Below are the outline and source of {_project(project)}.\n\n{outline}\n{source}\n"
        + OVERVIEW_TASK.format(extra="")
    )


def module_prompts(sources: DataFrame, outline: str, project: str) -> DataFrame:
    """``(dir, prompt)``: a module's source (or its digest) after the digest of the outline.

    ``sources`` has ``dir, text``; ``outline`` is bounded by the digest limit,
    whatever the size of the project.
    """
    head = f"You look at one module of {_project(project)}. Its outline, or a digest of it:\n\n{outline}\n"
    return sources.select(
        "dir",
        F.concat(
            _text(head), F.lit("\n## Source of `"), F.col("dir"), F.lit("`\n\n"), F.col("text"),
            F.lit("\n"), F.format_string(MODULE_TASK, F.col("dir")),
        ).alias("prompt"),
    )


def summary_parts(summaries: DataFrame) -> DataFrame:
    """``(path, text)``: the summary of each module."""
    block = F.concat(F.lit("### "), F.col("dir"), F.lit("\n"), F.col("summary"), F.lit("\n"))
    return summaries.select(F.col("dir").alias("path"), block.alias("text"))


def summaries_overview_prompt(outline: str, summaries: str, project: str) -> str:
    return (
        f"The outline of {_project(project)} and its module summaries follow, or digests of them.\n\n"
        f"## Outline\n\n{outline}\n\n## Module summaries\n\n{summaries}\n\n"
        + OVERVIEW_TASK.format(extra=", and how the modules depend on each other")
    )


def flow_identification_prompt(architecture: str, project: str) -> str:
    return (
        f"The architecture of {_project(project)}:\n\n{architecture}\n\n"
        "Name the three to five execution flows a developer should know first, each with a name of "
        "two to four words and one sentence on what to trace. Format each as:\n"
        "FLOW: <name>\nTRACE: <description>\n"
    )


def _flow_head(name: Column, description: Column, architecture: str, project: str) -> Column:
    return F.concat(
        F.lit("Trace the **"), name, _text(f"** flow of {_project(project)}.\n\n"), description,
        _text(f"\n\n## Architecture\n\n{architecture}\n\n"),
    )


def flow_prompts(
    flows: DataFrame, context: str, architecture: str, project: str
) -> DataFrame:
    """``(name, prompt)`` per flow.

    ``context`` is the source of a small project, or digests of the outline and
    the module summaries of a larger one.
    """
    return flows.select(
        "name",
        F.concat(
            _flow_head(F.col("name"), F.col("description"), architecture, project),
            _text(context), F.lit("\n"), F.format_string(FLOW_TASK, F.col("name")),
        ).alias("prompt"),
    )


def significance_prompt(title: str, content: str, diff: str) -> str:
    """Whether a change warrants writing an article again; ``diff`` may be a digest of a long one."""
    return (
        f"## Article: {title}\n\n{content}\n\n## Changes since it was written\n\n```diff\n{diff}\n```\n"
        "Do the changes alter what the article says about modules, interfaces, data flow or key "
        "algorithms? Ignore formatting, comments, tests and version numbers.\n"
        "Answer with one line:\nVERDICT: YES or NO\nthen, if you like, one sentence of reason.\n"
    )
