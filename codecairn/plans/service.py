"""Read side: search, symbol context, architecture, file list."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.config import DATA_DIR, Config, path_allowed
from codecairn.functions.text import extract_section, frontmatter_body, path_key
from codecairn.operators import graph, search
from codecairn.plans.store import Store
from codecairn.session import attach
from codecairn.sources.embedders import embed_query

_KEY = ("doc_type", "path", "chunk_ord")


def search_index(store: Store, query: str, k: int = 10, source: str = "all") -> DataFrame:
    """The best chunks with their text.

    Scoring reads keys and vectors only.  The ``k`` keys found then become a
    pushed-down filter, so the text of ``k`` chunks is read, not the index's.
    """
    config = store.config
    sides = {}
    for name, settings in (("docs", config.embedding), ("code", config.code_embedding)):
        present = store.exists(f"{name}_chunks")
        sides[name] = (
            store.read(f"{name}_chunks") if present else None,
            embed_query(query, settings) if present else None,
        )
    (docs, docs_query), (code, code_query) = sides["docs"], sides["code"]
    if docs is None and code is None:
        raise FileNotFoundError("docs index not found; build it first")
    if docs is None and source == "code":
        docs = code.limit(0)
    hits = search.search_vectors(docs, code, docs_query, code_query, k, _KEY, source)
    found = [tuple(r) for r in hits.collect()]
    columns = ("doc_type", "path", "chunk_ord", "title", "heading", "content")
    ranked = store.spark.createDataFrame(
        [(*f, i) for i, f in enumerate(found)],
        "doc_type string, path string, chunk_ord int, score double, side int, rank int",
    )
    if not found:
        texts = store.spark.createDataFrame([], "doc_type string, path string, chunk_ord int, "
                                                "title string, heading string, content string")
    else:
        wanted = search.key_filter([f[:3] for f in found], _KEY)
        parts = [side for side in (docs, code) if side is not None]
        texts = parts[0].select(*columns).where(wanted)
        for part in parts[1:]:
            texts = texts.unionByName(part.select(*columns).where(wanted))
    return (
        texts.join(F.broadcast(ranked), list(_KEY))
        .orderBy("rank")
        .select(
            F.col("path").alias("document"), "doc_type", "title", "heading", "content", "score"
        )
    )


def symbol_links(store: Store, file_path: str, symbol: str) -> tuple[list[dict], list[dict]]:
    """Callers and calls of a symbol; of each table one bucket is read.

    Both spellings name the same symbol: the graph writes A.b, descriptions A > b.
    """
    name = ".".join(symbol.split(" > ")[-2:])
    functions, calls = store.lookup("functions", file_path), store.lookup("calls", file_path)
    callers = graph.callers_of(graph.caller_edges(calls), file_path, name).collect()
    callees = graph.callees_of(functions, calls, file_path, name).collect()
    return [r.asDict() for r in callers], [r.asDict() for r in callees]


class Service:
    """Session over one opened project at a time."""

    def __init__(self, spark: SparkSession, allow: list[str] | None = None) -> None:
        self.spark = attach(spark)
        self.allow = list(allow or [])
        self.store: Store | None = None

    def open_project(self, repo_root: str) -> dict:
        path = Path(repo_root).resolve()
        if not path_allowed(path, self.allow):
            return {"error": f"path not allowed: {path}"}
        if not (path / DATA_DIR).is_dir():
            return {"error": f"no {DATA_DIR} folder at {path}"}
        # a new store per project: nothing of an earlier project survives
        self.store = Store(self.spark, Config.load(path))
        return {"status": "ok", "project": str(path)}

    def _opened(self) -> Store:
        if self.store is None:
            raise RuntimeError("no project loaded; call open_project first")
        return self.store

    def search_codebase(self, query: str, limit: int = 5, source: str = "all") -> dict:
        store = self._opened()
        if not store.exists("docs_chunks"):
            return {"error": "search index not found; run the index step first"}
        rows = search_index(store, query, limit, source).collect()
        if not rows:
            return {"results": [], "message": "No results found."}
        return {"results": [_shape(r) for r in rows]}

    def get_symbol_context(self, file_path: str, symbol: str = "") -> dict:
        store = self._opened()
        out: dict = {"file": file_path, "description": self._description(store, file_path, symbol)}
        if not store.exists("calls"):
            return out
        if symbol:
            callers, callees = symbol_links(store, file_path, symbol)
            if callers:
                out["callers"] = callers
            if callees:
                out["calls"] = callees
            return out
        stats = graph.function_stats_from_tables(store.lookup("functions", file_path), store.lookup("calls", file_path))
        rows = stats.orderBy("fn_ord").select(
            F.col("qualified_name").alias("name"), "calls_count", "callers_count"
        )
        listed = [r.asDict() for r in rows.collect()]
        if listed:
            out["functions"] = listed
        return out

    def _description(self, store: Store, file_path: str, symbol: str) -> str:
        body = frontmatter_body(F.col("markdown"))
        text = extract_section(body, F.lit(symbol)) if symbol else body
        row = (
            store.lookup("file_descriptions", file_path).select(text.alias("t")).first()
        )
        if row is None:
            return "No description available; run the describe step first."
        return row.t if row.t is not None else f"Symbol '{symbol}' not found in description."

    def get_architecture(self) -> dict:
        row = self._opened().lookup("articles", "architecture-overview").select("title", "content").first()
        if row is None:
            return {"error": "no architecture overview; run the synthesize step first"}
        return {"content": f"# {row.title}\n\n{row.content}".strip()}

    def files(self) -> DataFrame:
        """Described files in path order, with their call-graph totals where known."""
        store = self._opened()
        present = store.read("source_facts").select("path")  # what describes deleted files is not listed
        described = store.read("file_descriptions").select("path").join(present, "path", "left_semi")
        if store.exists("calls"):
            stats = graph.file_stats(
                graph.function_stats_from_tables(store.read("functions"), store.read("calls"))
            )
            described = described.join(stats, "path", "left")
        return described.orderBy(path_key(F.col("path")))

    def list_files(self) -> dict:
        """The file list as plain data; ``files`` yields entries as they are read."""
        if not self._opened().exists("file_descriptions"):
            return {"error": "no descriptions found; run the describe step first"}
        rows = self.files().toLocalIterator()
        return {"files": ({k: v for k, v in r.asDict().items() if v is not None} for r in rows)}


def _shape(row) -> dict:
    """A search result without its empty fields."""
    out = {"score": round(row.score, search.SCORE_DECIMALS), "document": row.document, "type": row.doc_type}
    for name in ("heading", "title"):
        if row[name]:
            out[name] = row[name]
    out["content"] = row.content
    return out
