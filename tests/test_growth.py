"""What must hold so that queries grow with their tables."""

import re
import sys
from datetime import date
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codecairn.catalog import tables
from codecairn.catalog.queries import registered
from codecairn.functions.pyfacts import apart, file_facts, parse_pieces, piece_facts
from codecairn.operators import graph
from codecairn.operators.wiring import wire

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="test data not present")
@pytest.mark.parametrize(
    "name",
    ["call_resolution", "caller_inversion", "describe_prompts", "edge_count", "file_graph_stats", "file_list",
     "function_stats", "symbol_context", "file_callers"],
)
def test_no_table_of_calls_or_texts_is_broadcast(spark, name):
    plan = registered()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


HEAD = "import os.path\nfrom .m import load, save as store\n\n"
DEFS = [
    f'@register("""\nclass {i}""")\nclass K{i}(Base):\n    def run(self):\n        return self.step(f{i - 1}(1)) + load(K{i})\n\n    def step(self): return step()\n'
    f"if x:\n    pass\nelse:\n    y = '''\ndef no(): pass\n'''\ndef f{i}(a):\n    return f{i // 2}(a) + os.path.join(a)\nL{i} = {i}\n"
    for i in range(40)
]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_sections_and_pieces_of_a_file_are_the_file(spark):
    whole = HEAD + "".join(DEFS)
    cuts = [HEAD + "".join(DEFS[:15]), "".join(DEFS[15:22]), "from .n import store, load\n" + "".join(DEFS[22:])]
    parsed = graph.parse_files(
        spark.createDataFrame([("a.py", bytearray("".join(cuts).encode())), ("b.py", bytearray(whole.encode())), ("c.py", bytearray(b"def ("))], "path string, content binary")
    )
    sections = [("a.py", i, bytearray(c.encode())) for i, c in enumerate(cuts)] + [
        ("b.py", None, bytearray(whole.encode())), ("c.py", None, bytearray(b"def (")),
        ("d.py", 0, bytearray(b"def f(): g()\n")), ("d.py", 1, bytearray(b"def (\n")),
    ]
    long = graph.parse_long_files(spark.createDataFrame(sections, "path string, section bigint, content binary"))
    assert _rows(graph.elements(long)) == _rows(graph.elements(parsed))
    want, got = wire(parsed), wire(long)
    assert _rows(got.calls) == _rows(want.calls)
    assert _rows(got.functions) == _rows(want.functions)


def test_a_long_file_is_read_in_pieces_of_whole_statements():
    whole = (HEAD + "".join(DEFS)).encode()
    pieces = list(piece_facts(whole, 500))
    assert len(pieces) > 10 and max(len(p) for p, _ in pieces) < len(whole) / 4
    assert b"".join(p for p, _ in pieces) == whole
    assert [e["scope_path"] for _, f in pieces for e in f["elements"]] == [e["scope_path"] for e in file_facts(whole)["elements"]]
    assert [f["error"] for _, f in piece_facts(whole + b"def (\n", 500)] == ["SyntaxError"]


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="test data not present")
@pytest.mark.parametrize(("name", "steps"), [("index_stats", 2), ("flagship_search", 3)])
def test_chunking_takes_one_python_worker_a_task(spark, name, steps):
    """``index_stats`` chunks two tables; ``flagship_search`` chunks one, embeds the chunks and scores them."""
    plan = registered()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == steps


def test_the_common_file_is_dealt_out_by_section(spark, tmp_path):
    """No task has all of it, links cross its sections, and neither table passes through the driver."""
    keys = range(0, 8 * tables.SECTION, 500)
    orders = [(k, k % 7, "F", "1-URGENT", date(1995, 1, 1)) for k in keys]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, c, 0.0) for c in range(7)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    files = tables.order_files(spark, str(tmp_path))
    assert "Broadcast" not in files._jdf.queryExecution().executedPlan().toString()
    placed = files.withColumn("task", F.spark_partition_id()).orderBy("section").collect()
    assert [r.section for r in placed] == list(range(8))
    assert len({r.task for r in placed}) > 1
    text = b"".join(r.content for r in placed).decode()
    assert text.count("import os.path") == 1
    assert [int(n) for n in re.findall(r"return f_(\d+)", text)] == [max(k - 500, 0) for k in keys]


def test_a_worker_does_not_keep_the_names_it_has_read():
    """The parser keeps names until its process ends, so none is read in the worker itself."""
    files = [(f"{k}.py", None, "".join(f"def f_{k}_{i}(a): return only_{k}_{i}(a)\n" for i in range(100)).encode()) for k in range(100)]
    schema = pa.schema([("path", pa.string()), ("section", pa.int64()), ("content", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*files), schema)], schema=schema)
    before = sys.getunicodeinternedsize()
    made = [r for _ in range(2) for b in parse_pieces(True)(iter([batch])) for r in b.to_pylist()]
    assert sys.getunicodeinternedsize() < before + 1000
    assert [r["path"] for r in made] == [f[0] for f in files] * 2
    assert all([e["name"] for e in r["facts"]["elements"]] == [f"f_{r['path'][:-3]}_{i}" for i in range(100)] for r in made)


def test_a_reader_that_dies_is_an_error():
    schema = pa.schema([("n", pa.int64())])

    def broken(n):
        yield pa.RecordBatch.from_arrays([pa.array([n])], schema=schema)
        raise SystemExit(3)

    with pytest.raises(RuntimeError, match="exit code 3"):
        list(apart(broken, 1, schema))
