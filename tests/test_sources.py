"""Scans, path predicates, configuration, providers."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecairn import config as cfg
from codecairn.functions.text import parent_dir, path_key, suffix
from codecairn.operators import search
from codecairn.sources import embedders
from codecairn.sources.files import (
    filter_files,
    keep_path,
    read_graph_yaml,
    read_markdown,
    scan_files,
    scan_roots,
)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_keep_path(spark):
    names = ["src/a.py", "src/tests/a.py", "tests/a.py", ".venv/a.py", "src/.x/a.py", "lib/build/gen/a.py", "a.PY", "a.txt"]
    kept = paths(spark, *names).where(keep_path(F.col("path"), cfg.DEFAULT_EXCLUDE)).collect()
    # a folder pattern does not match at the root
    assert {r.path for r in kept} == {"src/a.py", "tests/a.py"}


def test_path_order_and_parts(spark):
    names = ["a.py", "a-b.py", "B/x.py", "a/b.py", "a_b/c.py", "a/b/c.py"]
    rows = paths(spark, *names).orderBy(path_key(F.col("path"))).collect()
    assert [r.path for r in rows] == [str(p) for p in sorted(map(Path, names))]
    rows = paths(spark, "a/b.c.py", ".py", "x/.hid.py", "noext").select(
        "path", parent_dir(F.col("path")).alias("d"), suffix(F.col("path")).alias("s")
    ).collect()
    for r in rows:
        assert r.d == str(Path(r.path).parent) and r.s == Path(r.path).suffix


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "pkg/a.py": "A = 1\r\n", "pkg/sp ace+é%41.py": "B = 2\n", "pkg/tests/t.py": "T = 1\n",
        ".hid/h.py": "H = 1\n", "pkg/n.txt": "no", "top.py": "", "pkg/__init__.py": "", "_x/_y.py": "Y = 1\n", "bad.py": "",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    return tmp_path


def test_scan(spark, tree):
    rows = {r.path: r for r in scan_files(spark, tree, tree, cfg.DEFAULT_EXCLUDE).collect()}
    assert set(rows) == {
        "pkg/a.py", "pkg/sp ace+é%41.py", "top.py", "pkg/__init__.py", "_x/_y.py", "bad.py"
    }
    assert rows["bad.py"].source == "x = '\ufffd'\n"
    a = rows["pkg/a.py"]
    assert (a.dir, a.language, a.source, a.n_chars) == ("pkg", "python", "A = 1\n", 6)
    assert rows["top.py"].dir == "."
    import hashlib

    assert a.source_hash == hashlib.sha256(b"A = 1\r\n").hexdigest()[:12]


def test_single_file_is_taken_as_is(spark, tree):
    assert [r.path for r in scan_files(spark, tree / ".hid/h.py", tree, cfg.DEFAULT_EXCLUDE).collect()] == [".hid/h.py"]
    assert scan_files(spark, tree / "pkg/n.txt", tree).count() == 0


def test_overlapping_roots_repeat_files(spark, tree):
    assert scan_roots(spark, [tree / "pkg", tree / "pkg/tests"], tree).where("path like '%t.py'").count() == 2
    scanned = scan_files(spark, tree, tree)
    assert [r.path for r in filter_files(scanned, f"{tree.name}/top", tree).collect()] == ["top.py"]


def test_markdown_and_graph_yaml(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.md").write_bytes(b"# x\r\ny")
    (tmp_path / "d/a.yaml").write_text(
        "path: a.py\nfunctions:\n- name: f\n  calls:\n  - name: g\n    resolved: local\n  - name: h\n"
    )
    (tmp_path / "d/b.yaml").write_text("{")
    (tmp_path / "d/c.yaml").write_text("other: 1")
    row = read_markdown(spark, tmp_path, "article").first()
    assert (row.doc_type, row.path, row.text) == ("article", "d/x.md", "# x\ny")
    rows = read_graph_yaml(spark, tmp_path).collect()
    assert len(rows) == 1 and rows[0].functions[0].calls[1].asDict() == {"name": "h", "resolved": None}


def test_config_round_trip(tmp_path):
    project = tmp_path / "proj"
    project.mkdir()
    made = cfg.init_project(project, source_dirs=["src"])
    made.embedding = cfg.EmbeddingConfig(dimensions=32, query_prefix="q: ")
    made.save()
    again = cfg.init_project(project)  # keeps what is there
    assert again.embedding == made.embedding and again.project_name == "proj"
    assert again.roots() == [project / "src"]
    assert "batch_size" not in (project / cfg.DATA_DIR / cfg.CONFIG_NAME).read_text()
    (project / "src/deep").mkdir(parents=True)
    assert cfg.find_repo_root(project / "src/deep") == project
    assert cfg.resolve_root(None, project / "src") == project
    assert cfg.resolve_root(str(tmp_path), project) == tmp_path


def test_config_defaults(tmp_path):
    loaded = cfg.Config.load(tmp_path)
    assert loaded.exclude == list(cfg.DEFAULT_EXCLUDE) and loaded.roots() == [tmp_path]


def test_allow_list(tmp_path, monkeypatch):
    (tmp_path / "x").mkdir()
    assert cfg.path_allowed(tmp_path, [])
    assert cfg.path_allowed(tmp_path / "x", [f"{tmp_path}/**"])
    assert not cfg.path_allowed(tmp_path, [f"{tmp_path}/**"])
    monkeypatch.setenv("CODECAIRN_MODEL_SMALL", "m-1")
    assert (cfg.resolve_model("small"), cfg.resolve_model("m-2")) == ("m-1", "m-2")


def test_git_facts(tmp_path):
    assert cfg.head_commit(tmp_path) is None and not cfg.is_git_repo(tmp_path)
    assert cfg.has_uncommitted_changes(tmp_path) is False


# -- vectors -------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_cosine_top_k(spark):
    df = vectors(spark, [(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0])])
    rows = search.shown(search.top_k(df, [1.0, 0.0], 9, ["id"])).collect()
    assert [tuple(r) for r in rows] == [(1, 1.0), (4, 0.7071), (2, 0.0), (5, 0.0), (3, -1.0)]
    assert search.top_k(df, [1.0, 0.0], 0, ["id"]).collect() == []
    assert {r.score for r in search.top_k(df, [0.0, 0.0], 9, ["id"]).collect()} == {0.0}


def test_ranking_sees_more_decimals_than_are_shown(spark):
    close = vectors(spark, [(1, [0.600006, 0.799995]), (2, [0.600019, 0.799986]), (3, [0.0, 1.0])])
    best = search.top_k(close, [1.0, 0.0], 1, ["id"])
    assert [r.id for r in best.collect()] == [2]
    assert search.shown(best).first().score == 0.6
    halves = close.where("id = 1"), close.where("id = 2")
    merged = search.search_vectors(*halves, [1.0, 0.0], [1.0, 0.0], 1, ["id"])
    assert [r.id for r in merged.collect()] == [2]


@pytest.mark.parametrize("bad", [[(1, [1.0, 0.0])], [(1, [1.0]), (2, [1.0, 2.0, 3.0])], [(1, [1.0, None, 1.0])]])
def test_vectors_of_another_shape_are_an_error(spark, bad):
    query = [1.0] if len(bad) == 1 and len(bad[0][1]) == 2 else [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="dimensions|missing number"):
        search.top_k(vectors(spark, bad), query, 1, ["id"]).collect()


def test_null_vectors_are_skipped(spark):
    rows = search.top_k(vectors(spark, [(1, None), (2, [1.0, 0.0]), (3, None)]), [1.0, 0.0], 5, ["id"]).collect()
    assert [(r.id, r.score) for r in rows] == [(2, 1.0)]


def test_merge_prefers_docs(spark):
    docs, code = vectors(spark, [(7, [1.0, 0.0])]), vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    q = [1.0, 0.0]
    rows = search.search_vectors(docs, code, q, q, 2, ["id"]).collect()
    assert [(r.id, r.side) for r in rows] == [(7, 0), (1, 1)]
    assert search.search_vectors(docs, None, q, None, 2, ["id"], "code").collect() == []
    assert search.search_vectors(docs, None, q, None, 2, ["id"], "all").count() == 1
    for source in ("docs", "all"):
        with pytest.raises(FileNotFoundError):
            search.search_vectors(None, code, None, q, 2, ["id"], source)
    with pytest.raises(ValueError):
        search.search_vectors(docs, code, q, q, 2, ["id"], "other")


def test_top_k_keeps_only_k_rows_per_task(spark):
    plan = search.top_k(vectors(spark, [(1, [1.0])]), [1.0], 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_hashing_embedder(spark):
    config = cfg.EmbeddingConfig(dimensions=16)
    df = spark.createDataFrame([("Hello, hello WORLD",), ("",), (None,)], "t string")
    rows = df.select(embedders.embed_column(F.col("t"), config).alias("e")).collect()
    expected = embedders.HashingEmbedder(config).embed(["Hello, hello WORLD"])[0]
    assert np.allclose(rows[0].e, expected) and abs(np.linalg.norm(rows[0].e) - 1) < 1e-6
    assert embedders.embed_query("x", config) != embedders.embed_query("y", config)
    with pytest.raises(ValueError):
        embedders.provider(cfg.EmbeddingConfig(backend="nope"))


def http(answers, **kw):
    config = cfg.EmbeddingConfig(backend="remote", api_url="http://localhost/x", **kw)
    seen = []

    def post(texts):
        seen.append(list(texts))
        step = answers.pop(0) if answers else 200
        data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(texts)]
        return step, {"data": data[::-1]}

    client = embedders.HttpEmbedder(config, post)
    waits = []
    client._sleep = waits.append
    return client, seen, waits


def test_http_batches_keep_order():
    client, seen, _ = http([], batch_size=2, max_concurrent=1)
    assert client.embed(["a", "bb", "ccc", "dddd", "eeeee"]).ravel().tolist() == [1, 2, 3, 4, 5]
    assert [len(s) for s in seen] == [2, 2, 1]
    assert client.embed([]).size == 0


def test_http_retries_and_long_texts():
    client, _, waits = http([500, 503])
    assert client.embed(["a"]).tolist() == [[1.0]] and waits == [1, 2]
    client, _, waits = http([500, 500, 500])
    with pytest.raises(RuntimeError):
        client.embed(["a"])
    client, seen, _ = http([422, 422])  # two texts, then the first alone: its halves are pooled
    assert client.embed(["x" * 6000 + " " + "y" * 3000, "b"]).tolist() == [[1.0], [1.0]]
    assert [len(s) for s in seen] == [2, 1, 1, 1, 1] and seen[2][0] + seen[3][0] == seen[1][0]
    assert seen[2] == ["x" * 6000]
    client, _, waits = http([404])
    with pytest.raises(RuntimeError):
        client.embed(["a"])
    assert waits == []
    with pytest.raises(ValueError):
        embedders.HttpEmbedder(cfg.EmbeddingConfig(backend="remote"))


def test_prefixes_follow_the_backend():
    hashing, remote = cfg.EmbeddingConfig(), cfg.EmbeddingConfig(backend="remote")
    assert (hashing.before_document, hashing.before_query) == ("", "")
    assert (remote.before_document, remote.before_query) == (cfg.DOCUMENT_PREFIX, cfg.QUERY_PREFIX)
    assert cfg.EmbeddingConfig(doc_prefix="d ").before_document == "d "


def test_http_headers(monkeypatch):
    monkeypatch.setenv("CODECAIRN_HTTP_HEADERS", "a: b, junk, c:d:e")
    assert embedders.http_headers() == {"a": "b", "c": "d:e"}
