"""The build of a project: extract, graph, synthesize, describe, index.

Each stage reads stored tables and writes stored tables, so any stage can be
run alone or left out.  Nothing about single files is decided on the driver;
it only holds project-level digests, whose size is bounded (``plans.digest``).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.config import Config, EmbeddingConfig, has_uncommitted_changes, head_commit
from codecairn.functions.text import flow_file_name, module_file_name
from codecairn.operators import budgets, chunks, graph, prompts, responses, staleness
from codecairn.operators.changes import file_changes
from codecairn.operators.wiring import wire
from codecairn.plans import digest
from codecairn.plans.answers import ANSWERED
from codecairn.plans.store import Store
from codecairn.session import attach, materialize
from codecairn.sources.embedders import embed_column
from codecairn.sources.export import graph_yaml, write_texts
from codecairn.sources.files import filter_files, scan_roots

STEPS = ("extract", "graph", "synthesize", "describe", "index")

# Answer lengths of the synthesis prompts, rounds of follow-up
# questions about one file.
SUMMARY_TOKENS = 4096
ARTICLE_TOKENS = 8192
FLOW_TOKENS = 2048
VERDICT_TOKENS = 256

ARCHITECTURE = "architecture-overview"


@dataclass
class Build:
    """One run of the build over one project."""

    spark: SparkSession
    config: Config
    force: bool = False
    model: str | None = None
    report: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        attach(self.spark)
        self.store = Store(self.spark, self.config)
        self.model = self.model or self.config.model
        root = self.config.repo_root
        self.dirty = has_uncommitted_changes(root)
        self.commit = None if self.dirty else head_commit(root)

    # -- extract ------------------------------------------------------------

    def extract(self, targets: Sequence[Path] | None = None) -> None:
        """Scan and parse the files once; later stages read their facts."""
        files = scan_roots(
            self.spark, targets or self.config.roots(), self.config.repo_root, self.config.exclude
        )
        self.store.write("source_facts", graph.parse_files(files))
        facts = self.store.read("source_facts")
        self.store.write("elements", graph.elements(facts))
        self.store.write("imports", graph.raw_imports(facts))
        counted = facts.agg(
            F.count("*").alias("files"), F.count("facts.error").alias("parse_errors")
        ).first()
        self.report["extract"] = counted.asDict()

    # -- graph --------------------------------------------------------------

    def graph(self) -> None:
        facts = self.store.read("source_facts")
        wired = wire(facts)
        self.store.write("graph_imports", graph.graph_imports(facts))
        self.store.write("functions", wired.functions)
        self.store.write("calls", wired.calls)
        edges = graph.edge_count(self.store.read("calls")).first()
        self.report["graph"] = edges.asDict()

    # -- synthesize ---------------------------------------------------------

    def _hashes(self, names: Sequence[str]) -> DataFrame:
        """Current ``(name, path, hash)`` of articles that cover every file."""
        listed = F.explode(F.array(*[F.lit(n) for n in names])).alias("name")
        facts = self.store.read("source_facts")
        return facts.select(listed, "path", F.col("source_hash").alias("hash"))

    def _stale(self, current: DataFrame, names: DataFrame) -> DataFrame:
        return staleness.article_status(
            self.store.read("article_sources"), current, names, self.force
        ).where("stale")

    def _project_articles_stale(self, names: list[str]) -> set[str]:
        """Which of a few named project-wide articles are stale."""
        frame = self.spark.createDataFrame([(n,) for n in names], "name string")
        stale = self._stale(self._hashes(names), frame).select("name").collect()
        return {r["name"] for r in stale}

    def _save_articles(self, fresh: DataFrame, sources: DataFrame) -> None:
        """``(name, title, type, content)`` and the ``(name, path, hash)`` they cover."""
        rows = fresh.select(
            "name", "title", "type",
            F.lit(self.model).alias("model"),
            F.lit(self.commit).cast("string").alias("commit"),
            F.lit(self.dirty).alias("commit_dirty"),
            "content",
        )
        # sources last: an article without them is stale, so a lost run repeats it
        self.store.merge("articles", rows)
        self.store.merge("article_sources", sources.join(fresh.select("name"), "name", "left_semi"))

    def _article(self, name: str) -> str | None:
        row = self.store.lookup("articles", name).select("content").first()
        return row.content if row else None

    def _ask(self, prompt: str, tokens: int) -> str:
        frame = self.spark.createDataFrame([(0, prompt, tokens)], "k int, prompt string, max_tokens int")
        return self.store.answer(frame, ["k"], self.model, self.force).first().response

    def _digest(self, parts: DataFrame, subject: str) -> str:
        return digest.digest(self.store, parts, subject, self.config.project_name, self.model, self.force)

    def _source(self, files: DataFrame) -> str:
        """Source of every file in path order, or a digest of it."""
        block = prompts.file_block(F.col("path"), F.col("language"), F.col("source"))
        return self._digest(files.select("path", block.alias("text")), "the source")

    def _summaries(self, files: DataFrame, skeleton: str) -> int:
        """Write the stale module summaries; returns how many there were."""
        names = F.concat(F.lit("module-summaries/"), module_file_name(F.col("dir")))
        current = files.select(
            names.alias("name"), "dir", "path", F.col("source_hash").alias("hash")
        )
        modules = current.select("name", "dir").distinct()
        stale = materialize(
            self._stale(current.drop("dir"), modules).join(modules, "name").select("name", "dir")
        )
        count = stale.count()
        if not count:
            return 0
        work = files.join(stale, "dir", "left_semi")
        pieces = prompts.file_pieces(work, digest.DIGEST_CHARS)
        parts = pieces.select(
            F.col("dir").alias("key"),
            F.concat("path", F.lit("/"), F.lpad(F.col("piece").cast("string"), 9, "0")).alias("path"),
            F.col("block").alias("text"),
        )
        sources = digest.digests(
            self.store, parts, F.concat(F.lit("the source of the module `"), F.col("key"), F.lit("`")),
            self.config.project_name, self.model, self.force,
        ).withColumnRenamed("key", "dir")
        asked = prompts.module_prompts(sources, skeleton, self.config.project_name)
        summaries = self.store.answer(
            asked.withColumn("max_tokens", F.lit(SUMMARY_TOKENS)), ["dir"], self.model, self.force
        ).select("dir", F.col("response").alias("content"))
        fresh = summaries.join(stale, "dir").select(
            "name",
            F.concat(F.lit("Module: "), F.col("dir")).alias("title"),
            F.lit("module-summary").alias("type"),
            "content",
        )
        self._save_articles(materialize(fresh), current.select("name", "path", "hash"))
        return count

    def synthesize(self, skip_flows: bool = False) -> None:
        facts = self.store.read("source_facts")
        files = facts.select("path", "dir", "language", "source", "n_chars", "source_hash")
        batched = budgets.total_chars(files).first().needs_batching
        project = self.config.project_name
        skeletons = responses.file_skeletons(facts)
        generated, context = 0, None

        if batched:
            skeleton = self._digest(prompts.skeleton_parts(skeletons), "the outline")
            generated += self._summaries(files, skeleton)
            summaries = (
                self.store.read("articles")
                .where(F.col("type") == "module-summary")
                .select(
                    F.regexp_replace("title", "^Module: ", "").alias("dir"),
                    F.col("content").alias("summary"),
                )
                .join(files.select("dir").distinct(), "dir", "left_semi")
            )
            summary_text = self._digest(prompts.summary_parts(summaries), "the module summaries")
            context = f"## Outline\n\n{skeleton}\n\n## Module summaries\n\n{summary_text}\n"

        stale = self._project_articles_stale([ARCHITECTURE])
        new_overview = bool(stale) or generated > 0
        changes = materialize(file_changes(self.store.read("sources"), files))
        if new_overview and not self._significant(ARCHITECTURE, "Architecture Overview", changes):
            # the article stands, and covers the sources as they are now
            self.store.merge("article_sources", self._hashes([ARCHITECTURE]))
            new_overview = False
        if new_overview:
            if batched:
                text = prompts.summaries_overview_prompt(skeleton, summary_text, project)
            else:
                outline = self._digest(prompts.skeleton_parts(skeletons), "the outline")
                text = prompts.architecture_prompt(outline, self._source(files), project)
            content = self._ask(text, ARTICLE_TOKENS)
            fresh = self.spark.createDataFrame(
                [(ARCHITECTURE, "Architecture Overview", "architecture", content)],
                "name string, title string, type string, content string",
            )
            self._save_articles(fresh, self._hashes([ARCHITECTURE]))
            generated += 1

        if not skip_flows:
            generated += self._flows(new_overview, files, context)
        changed = files.join(changes.where("status <> 'removed'").select("path"), "path", "left_semi")
        self.store.merge(
            "sources", changed.select("path", "source_hash", "source"), changes.where("status = 'removed'").select("path")
        )
        self.report["synthesize"] = {"generated": generated, "batched": batched}

    def _significant(self, name: str, title: str, changes: DataFrame) -> bool:
        """Whether the changes since an article was written call for a new one."""
        content = self._article(name)
        if self.force or content is None or changes.isEmpty():
            return True
        parts = changes.select("path", F.concat(F.lit("--- "), "path", F.lit("\n"), "hunks").alias("text"))
        answer = self._ask(prompts.significance_prompt(title, content, self._digest(parts, "the changes")), VERDICT_TOKENS)
        row = self.spark.createDataFrame([(answer,)], "response string")
        return row.select(responses.verdict(F.col("response")).alias("v")).first().v

    def _flows(self, new_overview: bool, files: DataFrame, context: str | None) -> int:
        """Identify and write flows, only when any stored one may be out of date."""
        known = [
            r["name"]
            for r in self.store.read("articles").where(F.col("type") == "flow").select("name").collect()
        ]
        if known and not new_overview and not self._project_articles_stale(known):
            return 0
        project = self.config.project_name
        overview = self._article(ARCHITECTURE) or ""
        answer = self._ask(prompts.flow_identification_prompt(overview, project), FLOW_TOKENS)
        listed = (
            self.spark.createDataFrame([(answer,)], "response string")
            .select(F.inline(responses.flows(F.col("response"))).alias("flow", "description"))
            .select(
                "flow", "description", flow_file_name(F.col("flow")).alias("name")
            )
            .dropDuplicates(["name"])
        )
        names = [r["name"] for r in listed.select("name").collect()]  # three to five
        stale = self._project_articles_stale(names) if names else set()
        if not stale:
            return 0
        work = materialize(listed.where(F.col("name").isin(*stale)))
        if context is None:
            context = f"## Source\n\n{self._source(files)}"
        asked = prompts.flow_prompts(
            work.select(F.col("flow").alias("name"), "description"), context, overview, project
        ).select(F.col("name").alias("flow"), "prompt", F.lit(ARTICLE_TOKENS).alias("max_tokens"))
        answers = self.store.answer(asked, ["flow"], self.model, self.force)
        fresh = answers.join(work, "flow").select(
            "name",
            F.concat(F.lit("Flow: "), F.col("flow")).alias("title"),
            F.lit("flow").alias("type"),
            F.col("response").alias("content"),
        )
        self._save_articles(materialize(fresh), self._hashes(sorted(stale)))
        return len(stale)

    # -- describe -----------------------------------------------------------

    def _to_describe(self, file_filter: str | None) -> DataFrame:
        facts = self.store.read("source_facts")
        wanted = filter_files(facts, file_filter, self.config.repo_root) if file_filter else facts
        return staleness.stale_descriptions(
            wanted, self.store.read("file_descriptions"), self.force
        )

    def describe_prompts(self, file_filter: str | None = None) -> DataFrame:
        """The prompts a describe step would send (its dry run)."""
        work = self._to_describe(file_filter)
        return prompts.describe_prompts(
            graph.file_graphs(work, "dir", "language", "source", "n_chars", "facts"),
            self.store.read("source_facts").select("path", "dir", "source", "n_chars"),
            self._article(ARCHITECTURE),
            self.config.project_name,
        )

    def describe(self, file_filter: str | None = None) -> None:
        facts = self.store.read("source_facts")
        total, count = facts.count(), self._to_describe(file_filter).count()
        self.report["describe"] = {"generated": count, "cached": total - count}
        if not count:
            return
        asked = materialize(
            self.store.ask(self.describe_prompts(file_filter), ["path"], self.model, self.force)
        )
        # files without an answer stay undescribed, so the next run asks for them again
        self.store.write("failed_descriptions", asked.where(F.col("state") != ANSWERED).select("path", "attempts", "error"))
        answers = asked.where(F.col("state") == ANSWERED).select("path", "response")
        done = answers.count()
        self.report["describe"] |= {"generated": done, "failed": count - done}
        if not done:
            return
        files = facts.join(answers.select("path"), "path", "left_semi")
        elements = graph.elements(files).drop("body")
        summary = answers.select("path", responses.response_summary(F.col("response")).alias("summary"))
        symbols = responses.response_symbols(answers).withColumn("round", F.lit(0))
        turn, left = 0, None
        while True:  # until nothing is missing, or an answer brought nothing new
            missing = materialize(responses.missing_elements(elements, symbols))
            n = missing.count()
            if n == 0 or n == left:
                break
            turn, left = turn + 1, n
            more = prompts.continuation_prompts(
                missing, files.select("path", "language", "source"), self.config.project_name
            )
            followed = self.store.ask(more, ["path"], self.model, self.force).where(F.col("state") == ANSWERED)
            fresh = responses.response_symbols(followed).withColumn("round", F.lit(turn))
            symbols = materialize(symbols.unionByName(fresh))
        self.store.write("missing_descriptions", missing)
        # rounds follow each other; a file's symbols are few, so its row can hold them
        ordered = symbols.groupBy("path").agg(
            F.array_sort(F.collect_list(F.struct("round", "sym_ord", "scope_path", "description"))).alias("s")
        ).select("path", F.posexplode("s").alias("sym_ord", "x")).select(
            "path", "sym_ord", "x.scope_path", "x.description"
        )
        matched = materialize(responses.match_symbols(ordered, elements))
        listed = responses.symbol_list(matched)
        none = F.array().cast(listed.schema["symbols"].dataType)
        described = (
            files.select("path", "language", "source_hash")
            .join(summary, "path")
            .join(listed, "path", "left")
            .withColumn("model", F.lit(self.model))
            .withColumn(
                "markdown",
                responses.description_markdown(
                    F.col("path"), F.col("summary"), F.coalesce("symbols", none),
                    F.col("source_hash"), F.lit(""), F.col("model"),
                ),
            )
            .select("path", "language", "summary", "source_hash", "model", "markdown")
        )
        # symbols first: the file row marks the work as done
        columns = [c.split()[0] for c in _SYMBOL_COLUMNS.split(", ")]
        self.store.merge("symbol_descriptions", matched.select(*columns))
        self.store.merge("file_descriptions", described)

    # -- index --------------------------------------------------------------

    def markdown_documents(self) -> DataFrame:
        """Articles and descriptions as ``(doc_type, path, text)``.

        The frontmatter of an article leaves out its source list, which can
        name every file; the list is the table ``article_sources``.  What
        describes files or modules that are gone is left out.
        """
        present = self.store.read("source_facts").select("path", "dir")
        modules = present.select(F.concat(F.lit("Module: "), "dir").alias("title")).distinct()
        stored = self.store.read("articles")
        of_module = F.col("type") == "module-summary"
        stored = stored.where(~of_module).unionByName(stored.where(of_module).join(modules, "title", "left_semi").select(stored.columns))
        no_sources = F.array().cast("array<struct<path:string,hash:string>>")
        article = responses.article_markdown(
            F.col("title"), F.col("content"), F.col("type"), no_sources, F.col("model"),
            F.col("commit"), F.col("commit_dirty"),
        )
        articles = stored.select(
            F.lit("article").alias("doc_type"),
            F.concat(F.col("name"), F.lit(".md")).alias("path"),
            article.alias("text"),
        )
        described = self.store.read("file_descriptions").join(present, "path", "left_semi").select(
            F.lit("description").alias("doc_type"),
            F.concat(F.col("path"), F.lit(".md")).alias("path"),
            F.col("markdown").alias("text"),
        )
        return articles.unionByName(described)

    def _write_index(self, name: str, documents: DataFrame, pieces: DataFrame, config: EmbeddingConfig) -> int:
        embedded = pieces.withColumn("embedding", embed_column(F.col("embed_text"), config))
        self.store.write(f"{name}_documents", documents)
        self.store.write(f"{name}_chunks", embedded.drop("embed_text"), by="doc_type")
        written = self.store.read(f"{name}_chunks")
        count = written.count()
        facts = [(name, "embedding_model", config.model_name)]
        if count:
            first = written.select(F.size("embedding").alias("d")).first().d
            facts.append((name, "embedding_dim", str(first)))
        self.store.write(f"{name}_meta", self.spark.createDataFrame(facts, "index string, key string, value string"))
        return count

    def index(self) -> None:
        documents = self.markdown_documents()
        if documents.isEmpty():
            raise ValueError("no documents to index")
        docs = self._write_index(
            "docs", chunks.kb_documents(documents), chunks.chunk_markdown(documents), self.config.embedding
        )
        self.report["index"] = {"chunks": docs, "code_chunks": self.index_code()}

    def index_code(self) -> int:
        pieces = chunks.chunk_code(self.store.read("elements"))
        if pieces.isEmpty():
            raise ValueError("no code elements to index")
        return self._write_index(
            "code", chunks.code_documents(pieces), pieces, self.config.code_embedding
        )

    # -- files --------------------------------------------------------------

    def export(self, folder: str) -> dict:
        """Write articles, descriptions and the graph as files below a folder.

        Source lists go into the frontmatter of module summaries only: the
        other articles cover the whole project, whose list is a table.
        """
        sources = self.store.read("article_sources").where(
            F.startswith("name", F.lit("module-summaries/"))
        )
        listed = sources.groupBy("name").agg(
            F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("sources")
        )
        none = F.array().cast(listed.schema["sources"].dataType)
        article = responses.article_markdown(
            F.col("title"), F.col("content"), F.col("type"), F.coalesce("sources", none),
            F.col("model"), F.col("commit"), F.col("commit_dirty"),
        )
        articles = self.store.read("articles").join(listed, "name", "left").select(
            F.concat(F.lit("articles/"), F.col("name"), F.lit(".md")).alias("path"), article.alias("text")
        )
        described = self.store.read("file_descriptions").select(
            F.concat(F.lit("descriptions/"), F.col("path"), F.lit(".md")).alias("path"),
            F.col("markdown").alias("text"),
        )
        facts = self.store.read("source_facts").withColumn("imports", F.col("facts.graph_imports"))
        graphs = graph_yaml(graph.file_graphs(facts, "source_hash", "imports")).withColumn(
            "path", F.concat(F.lit("graph/"), F.col("path"))
        )
        return {
            "articles": write_texts(articles, folder),
            "descriptions": write_texts(described, folder),
            "graphs": write_texts(graphs, folder),
        }

    # -- all ----------------------------------------------------------------

    def update(
        self,
        targets: Sequence[Path] | None = None,
        skip_steps: Sequence[str] = (),
        skip_flows: bool = False,
    ) -> dict:
        """Run the steps in order, less the skipped ones, which then use stored tables."""
        actions = {
            "extract": lambda: self.extract(targets),
            "graph": self.graph,
            "synthesize": lambda: self.synthesize(skip_flows),
            "describe": self.describe,
            "index": self.index,
        }
        for step in STEPS:
            if step in skip_steps:
                self.report[step] = {"skipped": True}
                continue
            start = time.monotonic()
            actions[step]()
            self.report[step]["seconds"] = round(time.monotonic() - start, 3)
        return self.report


_SYMBOL_COLUMNS = (
    "path, sym_ord, scope_path, kind, signature, description, line_start, line_end"
)
