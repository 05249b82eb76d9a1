"""Command line: ``python -m codecairn <command>``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from codecairn.config import Config, init_project, resolve_root
from codecairn.functions.text import path_key
from codecairn.operators import graph
from codecairn.plans.service import search_index
from codecairn.plans.store import Store
from codecairn.plans.update import STEPS, Build
from codecairn.session import get_spark
from codecairn.sources.files import scan_files

# Characters shown of a docstring, of a chunk, of its first line.
DOC_PREVIEW, CONTENT_PREVIEW, LINE_PREVIEW = 80, 1000, 120


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="codecairn")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_text: str, path: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=help_text)
        if path:
            sub.add_argument("path", nargs="?", default=None)
        sub.add_argument("--repo-root", default=None)
        return sub

    sub = command("init", "create the project folder")
    sub.add_argument("--project-name", default="")
    sub.add_argument("--source-dir", action="append", default=[])
    sub = command("extract", "show the structure of a file or folder")
    sub.add_argument("--body", action="store_true")
    command("graph", "scan, parse and build the call graph")
    for name in ("synthesize", "describe", "update"):
        sub = command(name, f"run {name}")
        sub.add_argument("--model", default=None)
        sub.add_argument("--force", action="store_true")
        if name != "describe":
            sub.add_argument("--skip-flows", action="store_true")
        if name == "describe":
            sub.add_argument("--dry-run", action="store_true")
            sub.add_argument("--file-filter", default=None)
        if name == "update":
            sub.add_argument("--skip-step", action="append", default=[], choices=STEPS)
    command("index", "build the docs and code indexes", path=False)
    sub = command("export", "write articles, descriptions and graph as files", path=False)
    sub.add_argument("folder")
    sub = commands.add_parser("search", help="search the indexes")
    sub.add_argument("query")
    sub.add_argument("--repo-root", default=None)
    sub.add_argument("--top-k", type=int, default=5)
    sub.add_argument("--source", choices=("all", "docs", "code"), default="all")
    sub.add_argument("--verbose", "-v", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    target = Path(getattr(args, "path", None) or ".").resolve()
    root = resolve_root(args.repo_root, target)
    if args.command == "init":
        config = init_project(root, args.project_name, args.source_dir)
        print(f"project {config.project_name} at {config.data_dir}")
        return 0
    spark = get_spark()
    config = Config.load(root)
    if args.command == "extract":
        _show(graph.parse_files(scan_files(spark, target, root)), args.body)
        return 0
    if args.command == "search":
        return _search(Store(spark, config), args)
    build = Build(
        spark, config, force=getattr(args, "force", False), model=getattr(args, "model", None)
    )
    targets = [target] if getattr(args, "path", None) else None
    if args.command == "export":
        report = {"export": build.export(str(Path(args.folder).resolve()))}
    elif args.command == "update":
        report = build.update(targets, args.skip_step, args.skip_flows)
    else:
        if args.command != "index":
            build.extract(targets)
        if args.command in ("graph", "describe"):
            build.graph()
        if args.command == "synthesize":
            build.synthesize(args.skip_flows)
        elif args.command == "describe" and args.dry_run:
            for row in build.describe_prompts(args.file_filter).orderBy("path").toLocalIterator():
                print(f"--- {row.path} ({len(row.prompt)} characters)\n{row.prompt}")
        elif args.command == "describe":
            build.describe(args.file_filter)
        elif args.command == "index":
            build.index()
        report = build.report
    for i, (step, facts) in enumerate(report.items(), 1):
        detail = ", ".join(f"{k} {v}" for k, v in facts.items())
        print(f"[{i}/{len(report)}] {step:<12}{detail}")
    return 0


def _show(parsed, body: bool) -> None:
    doc = F.substring("docstring", 1, DOC_PREVIEW)
    rows = graph.elements(parsed).orderBy(path_key(F.col("path")), "elem_ord").withColumn("doc", doc)
    current = None
    for r in rows.toLocalIterator():
        if r.path != current:
            current = r.path
            print(f"\n{r.path}")
        pad = "  " * (r.depth + 1)
        print(f"{pad}{r.kind} {r.signature or r.name} [{r.line_start}-{r.line_end}]")
        if r.doc:
            print(f"{pad}  {r.doc}")
        if body:
            print(r.body)


def _search(store: Store, args) -> int:
    if not store.exists("docs_chunks"):
        print("index not found; run the index step first", file=sys.stderr)
        return 1
    rows = search_index(store, args.query, args.top_k, args.source).collect()
    if not rows:
        print("No results found.")
    for i, r in enumerate(rows, 1):
        print(f"\n[{i}] {r.score:.4f}  {r.document}  ({r.doc_type})")
        if r.heading:
            print(f"    {r.heading}")
        if args.verbose:
            cut = len(r.content) > CONTENT_PREVIEW
            print(r.content[:CONTENT_PREVIEW] + ("\n... (cut)" if cut else ""))
        else:
            print(f"    {r.content.splitlines()[0][:LINE_PREVIEW] if r.content else ''}")
    return 0
