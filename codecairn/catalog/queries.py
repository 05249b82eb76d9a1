"""The registered queries: each runs an operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.catalog import tables as t
from codecairn.config import DEFAULT_EXCLUDE, Config, EmbeddingConfig
from codecairn.functions import text as tx
from codecairn.functions.packing import pack_paragraphs
from codecairn.functions.vectors import l2_norm
from codecairn.operators import budgets, chunks, graph, prompts, responses, search, staleness
from codecairn.operators.wiring import Wiring, wire
from codecairn.operators.changes import file_changes
from codecairn.operators.ranking import rank_within
from codecairn.plans.answers import Answers
from codecairn.plans.service import search_index, symbol_links
from codecairn.plans.store import Store
from codecairn.plans.versions import BucketedTable, bucket_of
from codecairn.session import attach, keyed, shared_folder, spread
from codecairn.sources.embedders import embed_column, embed_query
from codecairn.sources.export import write_texts
from codecairn.sources.generators import TemplateGenerator
from codecairn.sources.files import excluded, file_columns, hidden, keep_path, read_markdown, scan_tree, supported

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the search queries.
QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
QUERY_TEXT = "the thing and the other one"
TOP_K = 10
COMMON_FILE, LOOKED_UP = "pkg/common.py", 5
FAIL_EVERY = 20
MERGE_BUCKETS = 64
EMBEDDING = EmbeddingConfig(dimensions=64)
PAGE_EXCLUDE = ("**/es/**", "*spam*", *DEFAULT_EXCLUDE)

_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        attach(spark)
        return fn(spark, sf_dir)

    _registry[fn.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_registry)


# -- search -------------------------------------------------------------------

def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_markdown(t.document_markdown(spark, sf_dir))


@query
def flagship_search(spark, sf_dir):
    """Documents to chunks to vectors to the best chunks for a text query."""
    vectors = _document_chunks(spark, sf_dir).withColumn(
        "embedding", embed_column(F.col("embed_text"), EMBEDDING)
    )
    hits = search.top_k(
        vectors,
        embed_query(QUERY_TEXT, EMBEDDING),
        TOP_K,
        ["doc_type", "path", "chunk_ord"],
        keep=["title", "heading", "content"],
    )
    return search.shown(hits).withColumnRenamed("path", "document")


@query
def vector_topk(spark, sf_dir):
    vectors = t.read(spark, sf_dir, "embeddings")
    return search.shown(search.top_k(vectors, QUERY_VECTOR, TOP_K, ["vec_id"]))


def _sides(spark, sf_dir):
    vectors = t.read(spark, sf_dir, "embeddings")
    return vectors.where(F.col("label") < 5), vectors.where(F.col("label") >= 5)


@query
def vector_topk_merged(spark, sf_dir):
    docs, code = _sides(spark, sf_dir)
    return search.shown(search.search_vectors(docs, code, QUERY_VECTOR, QUERY_VECTOR, TOP_K, ["vec_id"]))


@query
def source_selector(spark, sf_dir):
    docs, code = _sides(spark, sf_dir)
    found = [
        search.search_vectors(
            docs, code, QUERY_VECTOR, QUERY_VECTOR, TOP_K, ["vec_id"], source
        ).withColumn("source", F.lit(source))
        for source in ("docs", "code")
    ]
    return search.shown(found[0].unionByName(found[1]))


@query
def vector_norms(spark, sf_dir):
    return t.read(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(l2_norm(F.col("embedding")), 4).alias("norm")
    )


@query
def chunk_embeddings(spark, sf_dir):
    """Non-zero weights of every chunk vector."""
    vectors = _document_chunks(spark, sf_dir).select(
        "path", "chunk_ord", F.posexplode(embed_column(F.col("embed_text"), EMBEDDING)).alias("dim", "w")
    )
    return vectors.where(F.col("w") != 0).select(
        "path", "chunk_ord", "dim", F.round(F.col("w").cast("double"), 4).alias("weight")
    )


# -- text -----------------------------------------------------------------------

@query
def chunk_markdown(spark, sf_dir):
    return _document_chunks(spark, sf_dir).select(
        "path", "chunk_ord", "title", "heading", "content", "char_start", "char_end", "embed_text"
    )


@query
def chunk_turns(spark, sf_dir):
    return chunks.chunk_markdown(t.turn_markdown(spark, sf_dir)).select(
        "path", "chunk_ord", "heading", "content", "char_start", "char_end"
    )


@query
def heading_path(spark, sf_dir):
    return (
        chunks.with_sections(t.turn_markdown(spark, sf_dir))
        .select("path", F.posexplode_outer("sections").alias("section_ord", "s"))
        .where(F.col("s").isNotNull())
        .select("path", "section_ord", "s.heading", "s.level", "s.pos", "s.section_end")
    )


@query
def paragraph_pack(spark, sf_dir):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return (
        t.read_spread(spark, sf_dir, "documents", "doc_id", "text")
        .select("doc_id", F.posexplode(pack_paragraphs(text, chunks.CHUNK_TARGET)).alias("pack", "p"))
        .select("doc_id", "pack", "p.content", "p.start", "p.end")
    )


@query
def kb_documents(spark, sf_dir):
    """Articles and descriptions in one document table."""
    articles = chunks.kb_documents(t.document_markdown(spark, sf_dir))
    return articles.unionByName(chunks.kb_documents(t.turn_markdown(spark, sf_dir)))


@query
def index_stats(spark, sf_dir):
    docs = t.document_markdown(spark, sf_dir).unionByName(
        t.turn_markdown(spark, sf_dir).drop("role", "turn")
    )
    counted = chunks.chunk_markdown(docs).groupBy("doc_type").agg(F.count("*").alias("chunks"))
    totals = docs.groupBy("doc_type").agg(F.count("*").alias("documents"))
    return totals.join(counted, "doc_type", "left").select(
        "doc_type", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


@query
def frontmatter_split(spark, sf_dir):
    docs = t.document_markdown(spark, sf_dir)
    raw = tx.frontmatter_raw(F.col("text"))
    return docs.select(
        "path",
        raw.alias("raw"),
        tx.frontmatter_field(raw, "title").alias("title"),
        tx.content_hash(tx.frontmatter_body(F.col("text"))).alias("body_hash"),
        tx.content_hash(tx.drop_title_line(tx.frontmatter_body(F.col("text")))).alias("content_hash"),
    )


@query
def frontmatter_scalars(spark, sf_dir):
    scalars = tx.frontmatter_scalars(F.col("text"))
    return t.document_markdown(spark, sf_dir).select("path", F.explode(scalars).alias("key", "value"))


def _articles(spark, sf_dir):
    """One article per labelled document, made from the document and its label."""
    docs = t.read(spark, sf_dir, "documents").join(t.read(spark, sf_dir, "labels"), "doc_id", "left")
    rows = F.array(
        F.struct(F.concat(F.lit("docs/"), F.col("doc_id")).alias("path"), tx.content_hash(F.col("text")).alias("hash")),
        F.struct(F.concat(F.lit("langs/"), F.col("lang")).alias("path"), tx.content_hash(F.col("lang")).alias("hash")),
    )
    return docs.select(
        "doc_id",
        responses.article_markdown(
            F.concat(F.lit("Document "), F.col("doc_id")),
            F.col("text"),
            F.lit("synthesis"),
            F.when(F.col("quality").isNotNull(), rows),
            F.coalesce(F.col("lang"), F.lit("")),
            F.when(F.col("quality") == 1, F.lit("abc1234")),
            F.coalesce(F.col("toxic") == 1, F.lit(False)),
        ).alias("article"),
    )


@query
def article_render(spark, sf_dir):
    return _articles(spark, sf_dir)


@query
def sources_map(spark, sf_dir):
    listed = tx.frontmatter_sources(F.col("article"))
    return _articles(spark, sf_dir).select("doc_id", F.inline(listed)).select("doc_id", "path", "hash")


@query
def content_hash(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select(
        "doc_id", tx.content_hash(F.col("text")).alias("content_hash")
    )


@query
def section_extract(spark, sf_dir):
    docs = t.turn_markdown(spark, sf_dir)
    return docs.select(
        "path",
        tx.extract_section(F.col("text"), F.col("role")).alias("by_role"),
        tx.extract_section(F.col("text"), F.concat(F.lit("urn "), F.col("turn"))).alias("by_turn"),
        tx.extract_section(F.col("text"), F.lit("nowhere")).isNull().alias("by_nothing_is_null"),
    )


# -- paths and budgets ------------------------------------------------------------

@query
def path_columns(spark, sf_dir):
    pages = t.page_paths(spark, sf_dir)
    directory = tx.parent_dir(F.col("path"))
    return pages.select(
        "page_id",
        directory.alias("dir"),
        tx.suffix(F.col("path")).alias("ext"),
        tx.module_file_name(directory).alias("module_file"),
        tx.flow_file_name(F.col("path")).alias("flow_file"),
    )


@query
def glob_exclude(spark, sf_dir):
    path = F.col("path")
    return t.page_paths(spark, sf_dir).select(
        "page_id",
        "path",
        hidden(path).alias("hidden"),
        excluded(path, PAGE_EXCLUDE).alias("excluded"),
        supported(path).alias("supported"),
        keep_path(path, PAGE_EXCLUDE).alias("kept"),
    )


@query
def dir_groups(spark, sf_dir):
    pages = t.page_paths(spark, sf_dir).withColumn("dir", tx.parent_dir(F.col("path")))
    return budgets.directory_totals(pages)


@query
def project_size(spark, sf_dir):
    return budgets.total_chars(t.document_files(spark, sf_dir))


@query
def neighbor_budget(spark, sf_dir):
    return budgets.neighbor_summary(t.document_files(spark, sf_dir)).select(
        "path", "n_neighbors", "neighbor_chars", F.array_join("neighbors", ",").alias("neighbors")
    )


@query
def module_batches(spark, sf_dir):
    return budgets.module_batches(t.document_files(spark, sf_dir, "lang")).select("path", "batch")


@query
def first_occurrence(spark, sf_dir):
    """First place of each distinct value per user, and its last value."""
    return (
        t.read(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(F.min("event_id").alias("first_ord"), F.max_by("value", "event_id").alias("last_value"))
    )


# -- staleness --------------------------------------------------------------------

@query
def stale_descriptions(spark, sf_dir):
    return staleness.stale_descriptions(
        t.document_hashes(spark, sf_dir), t.described_documents(spark, sf_dir)
    )


@query
def description_actions(spark, sf_dir):
    return staleness.action_counts(
        staleness.description_actions(
            t.document_hashes(spark, sf_dir), t.described_documents(spark, sf_dir)
        )
    )


def _article_status(spark, sf_dir):
    stored, current = t.article_sources(spark, sf_dir)
    return staleness.article_status(stored, current, current.select("name").distinct())


@query
def stale_articles(spark, sf_dir):
    return _article_status(spark, sf_dir)


@query
def any_stale_article(spark, sf_dir):
    return staleness.any_stale(_article_status(spark, sf_dir))


# -- generated answers ------------------------------------------------------------

@query
def response_split(spark, sf_dir):
    return t.answers(spark, sf_dir).select(
        "path", responses.response_summary(F.col("response")).alias("summary")
    )


@query
def response_match(spark, sf_dir):
    symbols = responses.response_symbols(t.answers(spark, sf_dir))
    return responses.match_symbols(symbols, t.answer_elements(spark, sf_dir)).select(
        "path", "sym_ord", "scope_path", "kind", "signature", "description", "line_start", "line_end"
    )


@query
def missing_elements(spark, sf_dir):
    symbols = responses.response_symbols(t.answers(spark, sf_dir))
    return responses.missing_elements(t.answer_elements(spark, sf_dir), symbols).select(
        "path", "scope_path", "elem_ord"
    )


@query
def description_render(spark, sf_dir):
    """Description markdown of every answer."""
    answers = t.answers(spark, sf_dir)
    symbols = responses.match_symbols(
        responses.response_symbols(answers), t.answer_elements(spark, sf_dir)
    )
    listed = responses.symbol_list(symbols)
    none = F.lit("")
    return answers.join(listed, "path", "left").select(
        "path",
        responses.description_markdown(
            F.col("path"),
            responses.response_summary(F.col("response")),
            F.coalesce("symbols", F.array().cast(listed.schema["symbols"].dataType)),
            tx.content_hash(F.col("response")),
            none,
            F.lit("template"),
        ).alias("markdown"),
    )


@query
def flow_parse(spark, sf_dir):
    return t.flow_answers(spark, sf_dir).select(
        "path", F.posexplode(responses.flows(F.col("response"))).alias("flow_ord", "f")
    ).select("path", "flow_ord", "f.name", "f.description")


@query
def verdict_parse(spark, sf_dir):
    """Turns as evaluator answers: the role line is the verdict of every second role."""
    turns = t.read(spark, sf_dir, "conversations")
    answer = F.concat(
        F.col("text"),
        F.when(F.col("role") == "user", "\n verdict: yes, it changed").otherwise(
            F.when(F.col("turn") > 2, "\nVERDICT: NO\nVERDICT: YES").otherwise("")
        ),
    )
    return turns.select("conv_id", "turn", responses.verdict(answer).alias("regenerate"))


@query
def token_budget(spark, sf_dir):
    """Answer length asked for per labelled document, by its number of elements."""
    return responses.element_counts(t.answer_elements(spark, sf_dir)).select(
        "path", "n_elements", F.col("max_tokens").cast("long").alias("max_tokens")
    )


# -- code ---------------------------------------------------------------------------

def _parsed(spark, sf_dir):
    return graph.parse_files(t.part_files(spark, sf_dir))


@query
def py_elements(spark, sf_dir):
    return graph.elements(_parsed(spark, sf_dir)).select(
        "path", "elem_ord", F.coalesce("parent_ord", F.lit(-1)).alias("parent_ord"), "depth", "kind", "name", "scope_path", "signature",
        F.array_join("decorators", "\n").alias("decorators"), "docstring", "line_start", "line_end",
    )


@query
def py_raw_imports(spark, sf_dir):
    return graph.raw_imports(_parsed(spark, sf_dir)).select("path", "import_ord", "raw")


@query
def py_imports(spark, sf_dir):
    return graph.graph_imports(_parsed(spark, sf_dir)).select(
        "path", "import_ord", "module", F.array_join("names", ",").alias("names"), "alias"
    )


def _file_graphs(spark, sf_dir):
    return graph.file_graphs(_parsed(spark, sf_dir))


def _wired(spark, sf_dir) -> Wiring:
    return wire(_parsed(spark, sf_dir))


@query
def call_resolution(spark, sf_dir):
    return _wired(spark, sf_dir).calls


@query
def caller_inversion(spark, sf_dir):
    return _wired(spark, sf_dir).edges()


@query
def edge_count(spark, sf_dir):
    return graph.edge_count(_wired(spark, sf_dir).calls)


@query
def function_stats(spark, sf_dir):
    return _wired(spark, sf_dir).stats()


@query
def file_graph_stats(spark, sf_dir):
    return graph.file_stats(_wired(spark, sf_dir).stats())


@query
def file_callers(spark, sf_dir):
    return _wired(spark, sf_dir).callers()


def _order_wiring(spark, sf_dir) -> Wiring:
    return wire(graph.parse_long_files(t.order_files(spark, sf_dir), text=False))


@query
def order_calls(spark, sf_dir):
    """Resolved calls of files of very different sizes."""
    return _order_wiring(spark, sf_dir).calls


@query
def order_callers(spark, sf_dir):
    return _order_wiring(spark, sf_dir).callers()


@query
def order_caller_inversion(spark, sf_dir):
    return _order_wiring(spark, sf_dir).edges()


@query
def order_function_stats(spark, sf_dir):
    return _order_wiring(spark, sf_dir).stats()


@query
def order_elements(spark, sf_dir):
    """Elements of files of very different sizes; those that do not parse have none."""
    return graph.elements(graph.parse_long_files(t.order_files(spark, sf_dir))).select(
        "path", "elem_ord", F.coalesce("parent_ord", F.lit(-1)).alias("parent_ord"), "depth", "kind", "name", "scope_path", "signature",
        F.array_join("decorators", "\n").alias("decorators"), "docstring", "line_start", "line_end",
    )


@query
def code_chunks(spark, sf_dir):
    return chunks.chunk_code(graph.elements(_parsed(spark, sf_dir))).select(
        "path", "chunk_ord", "heading", "content", "char_start", "char_end", "embed_text"
    )


@query
def code_documents(spark, sf_dir):
    return chunks.code_documents(chunks.chunk_code(graph.elements(_parsed(spark, sf_dir))))


@query
def skeleton(spark, sf_dir):
    return responses.file_skeletons(_parsed(spark, sf_dir)).select(
        "path", responses.skeleton_block(F.col("path"), F.col("skeleton")).alias("skeleton")
    )


@query
def element_list(spark, sf_dir):
    e = graph.elements(_parsed(spark, sf_dir))
    bullet = responses.element_bullet(F.col("depth"), F.col("scope_path"), F.col("kind"), F.col("signature"))
    return e.select("path", "elem_ord", bullet.alias("bullet"))


@query
def symbol_context(spark, sf_dir):
    contexts = _wired(spark, sf_dir).contexts()
    named = F.transform(
        "calls", lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c.resolved, F.lit("?")))
    )
    return contexts.select(
        "path", "fn_ord", "qualified_name",
        F.array_join("callers", ",").alias("callers"), F.array_join(named, ",").alias("calls"),
    )


@query
def file_list(spark, sf_dir):
    """Part files and pages as described files, with call-graph totals where known."""
    stats = graph.file_stats(_wired(spark, sf_dir).stats())
    described = t.part_files(spark, sf_dir).select("path").unionByName(t.page_paths(spark, sf_dir).select("path"))
    return described.join(keyed(stats), "path", "left").select(
        "path",
        F.coalesce("functions", F.lit(0)).alias("functions"),
        F.coalesce("total_callers", F.lit(0)).alias("total_callers"),
        F.coalesce("total_calls", F.lit(0)).alias("total_calls"),
    )


@query
def tree_round_trip(spark, sf_dir):
    """Pages written as a tree of files, and what a scan of the tree reads."""
    folder = shared_folder(spark)
    write_texts(t.page_files(spark, sf_dir), folder)
    return scan_tree(spark, folder, "src", DEFAULT_EXCLUDE).select("path", "dir", "language", "n_chars", "source_hash")


@query
def markdown_round_trip(spark, sf_dir):
    """Documents written as markdown files, and the articles read back from them."""
    folder = shared_folder(spark)
    files = t.document_markdown(spark, sf_dir).select(F.concat("path", F.lit(".md")).alias("path"), "text")
    write_texts(files, folder)
    read = read_markdown(spark, folder, "article")
    return read.select("doc_type", "path", F.length("text").cast("long").alias("n_chars"), tx.content_hash(F.col("text")).alias("hash"))


def _store(spark) -> Store:
    """A store of its own for a query, in the shared folder."""
    return Store(spark, Config(tables=shared_folder(spark), embedding=EMBEDDING, code_embedding=EMBEDDING))


@query
def stored_search(spark, sf_dir):
    """The flagship search over a written index, texts fetched by key."""
    store = _store(spark)
    vectors = _document_chunks(spark, sf_dir).withColumn("embedding", embed_column(F.col("embed_text"), EMBEDDING))
    store.write("docs_chunks", vectors.drop("embed_text"), by="doc_type")
    return search.shown(search_index(store, QUERY_TEXT, TOP_K, "docs"))


@query
def stored_symbols(spark, sf_dir):
    """Callers and calls of the first functions of the common file, looked up in stored tables."""
    store, wired = _store(spark), _order_wiring(spark, sf_dir)
    store.write("functions", wired.functions)
    store.write("calls", wired.calls)
    names = store.lookup("functions", COMMON_FILE).where(F.col("fn_ord") < LOOKED_UP).select("qualified_name").collect()
    rows = []
    for r in names:
        for kind, links in zip(("caller", "call"), symbol_links(store, COMMON_FILE, r.qualified_name)):
            rows += [(r.qualified_name, kind, x.get("function", x.get("name")), x.get("resolved")) for x in links]
    return spark.createDataFrame(rows, "symbol string, kind string, name string, resolved string")


@query
def source_changes(spark, sf_dir):
    """Lines that came to and went from documents, each between two versions of its text.

    The old version has a line of its own behind every third line, the new one
    behind every fifth; some documents have no old or no new version.
    """
    def marked(every, mark):
        lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % every == 0, F.concat(x, F.lit("\n#" + mark), i)).otherwise(x))
        return F.array_join(lines, "\n")

    docs = t.read_spread(spark, sf_dir, "documents", "doc_id", "text")
    path = F.concat(F.lit("docs/"), "doc_id").alias("path")

    def version(every, mark, but):
        made = docs.where(F.col("doc_id") % 50 != but).select(path, marked(every, mark).alias("source"))
        return made.withColumn("source_hash", tx.content_hash(F.col("source")))

    return file_changes(version(3, "old", 1), version(5, "new", 2)).select("path", "status", "added", "removed")


@query
def store_merge(spark, sf_dir):
    """Buckets of a table before and after one row in a hundred is merged into it."""
    docs = t.read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("chars"))
    rows = docs.count()
    table = BucketedTable(spark, shared_folder(spark), ("doc_id",), bucket_rows=max(1, -(-rows // MERGE_BUCKETS)))
    table.merge(docs)
    before = table.manifest()
    table.merge(docs.where("doc_id % 100 = 0").withColumn("chars", -F.col("chars") - 1))
    after = table.manifest()
    written = [(int(b), p != before["parts"].get(b), p["rows"]) for b, p in after["parts"].items()]
    parts = spark.createDataFrame(written, "bucket int, rewritten boolean, listed bigint")
    held = table.read().withColumn("bucket", bucket_of(["doc_id"], after["buckets"])).groupBy("bucket").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("chars") < 0).alias("merged"), F.sum("chars").alias("chars")
    )
    return parts.join(held, "bucket").select("bucket", "rewritten", "listed", "n_rows", "merged", "chars")


# Parameters of the prompt query.
ARCHITECTURE_TEXT = "Parts import their kind and price themselves."
PROJECT = "parts"


@query
def describe_prompts(spark, sf_dir):
    """Prompt of every part file: neighbours within budget, source, callers, elements."""
    files = file_columns(t.part_files(spark, sf_dir))
    work = graph.file_graphs(
        graph.parse_files(files), "dir", "language", "source", "n_chars", "facts"
    )
    made = prompts.describe_prompts(work, files, ARCHITECTURE_TEXT, PROJECT)
    return made.select("path", "prompt", "max_tokens")


@query
def path_order(spark, sf_dir):
    """Rank of every page's file in its host, folders before what sorts after them as text."""
    paths = t.page_paths(spark, sf_dir).withColumn("host", F.substring_index("path", "/", 1))
    paths = paths.withColumn("_key", tx.path_key(F.col("path")))
    return rank_within(paths, "host", ["_key", "page_id"]).select("page_id", "path", F.col("rank").cast("int").alias("rank"))


class _Failing(TemplateGenerator):
    """The offline provider; it fails for every twentieth request."""

    def __call__(self, prompt: str, max_tokens: int) -> str:
        if max_tokens % FAIL_EVERY == 0:
            raise TimeoutError(f"no answer to {max_tokens}")
        return super().__call__(prompt, max_tokens)


@query
def answer_loop(spark, sf_dir):
    """Documents asked about by a provider that fails for some: each with its state, attempts, answer."""
    docs = t.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("doc_id").cast("int").alias("max_tokens"))
    asked = Answers(spark, shared_folder(spark), "template", "1", _Failing).ask(spread(docs), ["doc_id"])
    return asked.select("doc_id", "state", "attempts", "response", "error")


@query
def file_pieces(spark, sf_dir):
    """Documents as files of a module's prompt, long ones in pieces."""
    files = t.read(spark, sf_dir, "documents").select(
        F.col("source").alias("dir"),
        F.concat_ws("/", "source", "doc_id").alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("source"),
    )
    return prompts.file_pieces(files, 1000).select("path", "piece", "n_pieces", "block")
