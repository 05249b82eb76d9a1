"""Bucketed tables: merges, versions, readers, merges that die."""

import pytest
from pyspark.sql import functions as F

from codecairn.plans.versions import BucketedTable, Conflict, bucket_of, bucket_of_values


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame(data, "path string, n int, text string")


@pytest.fixture
def table(spark, tmp_path):
    made = BucketedTable(spark, f"file://{tmp_path}/t", ("path",), bucket_rows=10)
    made.merge(frame(spark, [(f"p{i // 2}", i % 2, f"old {i}") for i in range(200)]))
    return made


def files(tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.parquet")}


def test_merge_writes_only_touched_buckets(spark, table, tmp_path):
    before, manifest = files(tmp_path), table.manifest()
    assert manifest["buckets"] == 20 and sum(p["rows"] for p in manifest["parts"].values()) == 200
    reader = table.read()
    table.merge(frame(spark, [("p3", 0, "new"), ("q", 0, "added"), (None, 0, "nameless")]))
    want = {(f"p{i // 2}", i % 2, f"old {i}") for i in range(200) if i // 2 != 3}
    want |= {("p3", 0, "new"), ("q", 0, "added"), (None, 0, "nameless")}
    assert set(map(tuple, table.read().collect())) == want
    after = table.manifest()
    touched = {str(bucket_of_values([k], 20)) for k in ("p3", "q", None)}
    assert {b for b in after["parts"] if after["parts"][b] != manifest["parts"].get(b)} == touched
    kept = {f: t for f, t in before.items() if f"bucket={f.split('bucket=')[1].split('/')[0]}" not in {f"bucket={b}" for b in touched}}
    assert kept.items() <= files(tmp_path).items()
    # a reader that was there before sees its own version, as does one that asks for it
    assert reader.count() == 200 and table.read(manifest["version"]).count() == 200


def test_bucket_of_rows_and_of_values_agree(spark):
    data = [("a", 1, "x"), (None, None, None), ("", 2, "é"), ("a\x1fb", 3, "")]
    got = frame(spark, data).select(bucket_of(["path", "n"], 97)).collect()
    assert [r[0] for r in got] == [bucket_of_values(d[:2], 97) for d in data]


def test_lookup_reads_one_bucket(spark, table):
    found = table.lookup("p7")
    assert rows(found) == [("p7", 0, "old 14"), ("p7", 1, "old 15")]
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert table.lookup("none").count() == 0


def test_a_merge_that_dies_changes_nothing(spark, table):
    before = rows(table.read())
    dying = frame(spark, [("p1", 0, "x"), ("p2", 0, "y")]).withColumn("text", F.expr("if(path = 'p2', raise_error('lost'), text)"))
    with pytest.raises(Exception, match="lost"):
        table.merge(dying)
    assert rows(table.read()) == before and table.versions() == [1]
    # one that dies between its files and its manifest leaves files nobody reads
    publish, table._publish = table._publish, lambda manifest: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError, match="gone"):
        table.merge(frame(spark, [("p1", 0, "x")]))
    assert rows(table.read()) == before
    table._publish = publish
    table.merge(frame(spark, [("p1", 0, "x")]))
    assert rows(table.read()) == sorted([r for r in before if r[0] != "p1"] + [("p1", 0, "x")])


def test_the_later_of_two_merges_fails(spark, table):
    stale = table.manifest()
    table.merge(frame(spark, [("p1", 0, "first")]))
    late = BucketedTable(spark, table.folder, ("path",), bucket_rows=10)
    late.manifest = lambda version=None: stale
    with pytest.raises(Conflict):
        late.merge(frame(spark, [("p1", 0, "second")]))
    assert rows(table.lookup("p1")) == [("p1", 0, "first")]


def test_many_rows_of_one_key_are_dealt_out(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ("path",), ("n",), bucket_rows=10)
    table.merge(frame(spark, [("hot", i, "old") for i in range(100)] + [("cold", 0, "old")]))
    assert len(table.manifest()["parts"]) > 5
    table.merge(frame(spark, [("hot", 1, "new")]))
    assert rows(table.read()) == [("cold", 0, "old"), ("hot", 1, "new")]
    assert rows(table.lookup("hot")) == [("hot", 1, "new")]


def test_growth_deals_the_table_anew_and_old_versions_go(spark, table, tmp_path):
    for k in range(5):
        table.merge(frame(spark, [(f"more{k}-{i}", 0, "x") for i in range(300)]))
    assert table.read().count() == 1700 and table.manifest()["buckets"] > 20
    assert len(table.versions()) == 3
    used = {p["folder"] for v in table.versions() for p in table.manifest(v)["parts"].values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == used


def test_empty_merges(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ("path",))
    table.merge(frame(spark, []))
    assert table.read().count() == 0
    table.merge(frame(spark, [("a", 0, "x")]))
    table.merge(frame(spark, []))
    assert rows(table.read()) == [("a", 0, "x")]


def test_symbol_look_ups_read_one_bucket(spark, tmp_path, monkeypatch):
    from codecairn.config import Config
    from codecairn.plans import versions
    from codecairn.plans.service import symbol_links
    from codecairn.plans.store import Store

    monkeypatch.setattr(versions.BucketedTable.__init__, "__defaults__", ((), 10))
    store = Store(spark, Config(tables=f"file://{tmp_path}"))
    fns = [(f"f{i % 40}.py", i // 40, f"fn{i // 40}") for i in range(200)]
    store.write("functions", spark.createDataFrame(fns, "path string, fn_ord int, qualified_name string"))
    calls = [(p, o, n, 0, "fn0", "local", True) for p, o, n in fns]
    store.write("calls", spark.createDataFrame(calls, "path string, fn_ord int, caller string, call_ord int, name string, resolved string, wired boolean"))
    assert store.bucketed("calls").manifest()["buckets"] == 20
    callers, callees = symbol_links(store, "f7.py", "fn0")
    assert callers == [{"file": "f7.py", "function": f"fn{i}"} for i in range(5)]
    assert callees == [{"name": "fn0", "resolved": "local"}]
    assert len({f.split("bucket=")[1].split("/")[0] for f in store.lookup("calls", "f7.py").inputFiles()}) == 1
