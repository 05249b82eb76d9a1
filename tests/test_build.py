"""The whole build on a small project, offline, and what it serves."""


import pytest
from pyspark.sql import functions as F
from test_code import SHOP

from codecairn.config import EmbeddingConfig, init_project
from codecairn.operators import budgets
from codecairn.plans import digest
from codecairn.plans.service import Service, search_index
from codecairn.plans.store import Store
from codecairn.plans.update import Build
from codecairn.sources.files import read_graph_yaml, read_markdown

BIG = "\n".join(f"def f{i}():\n    return g{i}()\n" for i in range(200))


def make(tmp_path):
    for name, text in {
        "pkg/shop.py": SHOP, "pkg/__init__.py": "", "pkg/util.py": "def load(x):\n    return x\n",
        "big.py": BIG, "broken.py": "def (\n", "pkg/tests/t.py": "T = 1\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    config = init_project(tmp_path, "demo")
    config.embedding = EmbeddingConfig(dimensions=64)
    config.save()
    return config


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    config = make(tmp_path_factory.mktemp("demo"))
    build = Build(spark, config)
    build.update()
    return config, build


def test_first_build(spark, built):
    config, build = built
    report = build.report
    assert report["extract"]["files"] == 5 and report["extract"]["parse_errors"] == 1
    assert report["graph"]["edges"] == 3
    assert report["synthesize"] == {**report["synthesize"], "generated": 4, "batched": False}
    assert (report["describe"]["generated"], report["describe"]["cached"]) == (5, 0)
    articles = build.store.read("articles")
    assert {r.name for r in articles.collect()} == {
        "architecture-overview", "flow-start-up", "flow-main-work", "flow-wind-down"
    }
    # an answer holds 163 elements at most, so the rest came from follow-up questions
    symbols = build.store.read("symbol_descriptions")
    assert symbols.where("path = 'big.py'").count() == 200
    assert symbols.where("path = 'big.py' and kind = 'function' and line_start > 0").count() == 200
    meta = {r.key: r.value for r in build.store.read("docs_meta").collect()}
    assert meta == {"embedding_model": "hashing", "embedding_dim": "64"}


def test_prompts_hold_what_they_should(spark, built):
    config, _ = built
    force = Build(spark, config, force=True)
    prompts = {r.path: r for r in force.describe_prompts().collect()}
    shop = prompts["pkg/shop.py"]
    order = ["This is the file `pkg/shop.py` of `demo`", "## Architecture", "### pkg/util.py", "Empty files: 1",
             "### pkg/shop.py\n```python\n",
             "## Elements to describe", "    - **Cart > Row > key** (method) — `def key(self)`",
             "## Known callers\n\n- `top` is called by: `Cart.add` (pkg/shop.py)", "## Answer format"]
    places = [shop.prompt.find(part) for part in order]
    assert -1 not in places and places == sorted(places)
    assert shop.max_tokens == 4096 and prompts["big.py"].max_tokens == 16384
    assert "### pkg/util.py" not in prompts["big.py"].prompt
    only = force.describe_prompts("util").collect()
    assert [r.path for r in only] == ["pkg/util.py"]


def test_second_build_generates_nothing(spark, built):
    config, _ = built
    before = Store(spark, config).read("attempts").count()
    report = Build(spark, config).update()
    assert report["synthesize"]["generated"] == 0
    assert (report["describe"]["generated"], report["describe"]["cached"]) == (0, 5)
    assert Store(spark, config).read("attempts").count() == before


def test_service(spark, built):
    config, _ = built
    service = Service(spark)
    with pytest.raises(RuntimeError):
        service.list_files()
    assert "error" in service.open_project(str(config.repo_root / "pkg"))
    assert service.open_project(str(config.repo_root))["status"] == "ok"
    context = service.get_symbol_context("pkg/shop.py", "Cart.add")
    assert context["description"] == "## `Cart > add` — `def add(self, n)`\n\nThe method Cart > add."
    assert context["calls"] == [{"name": "top", "resolved": "local"}, {"name": "check", "resolved": None}]
    assert service.get_symbol_context("pkg/shop.py", "Cart > add") == context
    assert service.get_symbol_context("pkg/shop.py", "top")["callers"] == [
        {"file": "pkg/shop.py", "function": "Cart.add"}
    ]
    whole = service.get_symbol_context("pkg/shop.py")
    assert whole["functions"][0] == {"name": "top", "calls_count": 3, "callers_count": 1}
    assert whole["description"].startswith("# pkg/shop.py\n\nGenerated text")
    assert service.get_symbol_context("none.py")["description"].startswith("No description")
    assert "not found" in service.get_symbol_context("pkg/shop.py", "zzz")["description"]
    assert service.get_architecture()["content"].startswith("# Architecture Overview\n\nGenerated text")
    files = list(service.list_files()["files"])
    assert [f["path"] for f in files] == ["big.py", "broken.py", "pkg/__init__.py", "pkg/shop.py", "pkg/util.py"]
    assert files[3] == {"path": "pkg/shop.py", "functions": 5, "total_callers": 1, "total_calls": 8}
    assert Service(spark, ["/nowhere/*"]).open_project(str(config.repo_root))["error"]


def test_search(spark, built):
    config, build = built
    service = Service(spark)
    service.open_project(str(config.repo_root))
    hits = service.search_codebase("class Cart Base metaclass Meta Holds items Second line SIZE property total", 3, "code")["results"]
    assert hits[0]["type"] == "code" and hits[0]["document"] == "pkg/shop.py"
    both = search_index(build.store, "method cart add", 7).collect()
    assert len(both) == 7 and [r.score for r in both] == sorted((r.score for r in both), reverse=True)
    docs = search_index(build.store, "method cart add", 7, "docs").collect()
    assert {r.doc_type for r in docs} <= {"article", "description"}
    code = search_index(build.store, "method cart add", 7, "code").collect()
    best = sorted([(-r.score, s) for s, side in enumerate((docs, code)) for r in side])[:7]
    assert [-b[0] for b in best] == [r.score for r in both]


def test_export(spark, built, tmp_path):
    config, build = built
    assert build.export(str(tmp_path)) == {"articles": 4, "descriptions": 5, "graphs": 5}
    text = (tmp_path / "descriptions/pkg/shop.py.md").read_text()
    assert text.startswith("---\nsource: pkg/shop.py\nsource_hash: ")
    docs = read_markdown(spark, tmp_path / "articles", "article")
    assert sorted(r.path for r in docs.collect())[0] == "architecture-overview.md"
    graphs = {r.path: r for r in read_graph_yaml(spark, tmp_path / "graph").collect()}
    stored = build.store.read("functions").where("path = 'pkg/shop.py'").orderBy("fn_ord").collect()
    assert [f.name for f in graphs["pkg/shop.py"].functions] == [r.name for r in stored]
    assert [c.asDict() for c in graphs["pkg/shop.py"].functions[3].calls] == [
        {"name": "top", "resolved": "local"}, {"name": "check", "resolved": None}
    ]


def test_changes_are_picked_up(spark, tmp_path):
    config = make(tmp_path)
    Build(spark, config).update(skip_steps=["index"])
    (tmp_path / "pkg/util.py").write_text("def load(x):\n    return x + 1\n")
    (tmp_path / "pkg/new.py").write_text("N = 1\n")
    (tmp_path / "broken.py").unlink()
    build = Build(spark, config)
    report = build.update(skip_steps=["index"], skip_flows=True)
    assert (report["describe"]["generated"], report["describe"]["cached"]) == (2, 3)
    assert report["synthesize"]["generated"] == 1 and report["index"] == {"skipped": True}
    covered = {r.path for r in build.store.read("article_sources").where("name = 'architecture-overview'").collect()}
    assert covered == {"big.py", "pkg/__init__.py", "pkg/shop.py", "pkg/util.py", "pkg/new.py"}
    assert build.store.read("file_descriptions").count() == 6


def test_large_projects_are_summarized_by_module(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(budgets, "SINGLE_PASS_CHARS", 1000)
    monkeypatch.setattr(digest, "DIGEST_CHARS", 900)
    config = make(tmp_path)
    build = Build(spark, config)
    build.update(skip_steps=["describe", "index"])
    assert build.report["synthesize"]["generated"] == 2 + 1 + 3
    modules = build.store.read("articles").where("type = 'module-summary'")
    assert {(r.name, r.title) for r in modules.collect()} == {
        ("module-summaries/_root", "Module: ."), ("module-summaries/pkg", "Module: pkg")
    }
    sources = build.store.read("article_sources").groupBy("name").agg(F.count("*").alias("n"))
    assert {r.name: r.n for r in sources.collect()} == {
        "module-summaries/_root": 2, "module-summaries/pkg": 3, "architecture-overview": 5,
        "flow-start-up": 5, "flow-main-work": 5, "flow-wind-down": 5,
    }
    again = Build(spark, config)
    again.synthesize()
    assert again.report["synthesize"]["generated"] == 0
    (tmp_path / "pkg/util.py").write_text("U = 1\n")
    third = Build(spark, config)
    third.extract()
    third.synthesize()
    assert third.report["synthesize"]["generated"] == 1 + 1 + 3


def test_nothing_to_index(spark, tmp_path):
    config = init_project(tmp_path)
    build = Build(spark, config)
    build.extract()
    with pytest.raises(ValueError, match="no documents"):
        build.index()
    with pytest.raises(ValueError, match="no code"):
        build.index_code()


def test_command_line(spark, tmp_path, capsys):
    from codecairn.cli import main

    make(tmp_path)
    assert main(["search", "x", "--repo-root", str(tmp_path)]) == 1
    assert main(["extract", str(tmp_path / "pkg/shop.py"), "--repo-root", str(tmp_path)]) == 0
    assert "method def total(self) [29-30]" in capsys.readouterr().out
    assert main(["describe", str(tmp_path), "--dry-run", "--file-filter", "util"]) == 0
    assert "--- pkg/util.py" in capsys.readouterr().out
    assert main(["update", str(tmp_path), "--skip-step", "synthesize"]) == 0
    assert "generated 5, cached 0" in capsys.readouterr().out
    assert main(["search", "load", "--repo-root", str(tmp_path), "--top-k", "2"]) == 0
    assert "[2] 0." in capsys.readouterr().out
