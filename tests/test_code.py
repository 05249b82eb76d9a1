"""Structure and call graph of Python source."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codecairn.functions.pyfacts import file_facts
from codecairn.operators import chunks, graph, responses
from codecairn.operators.wiring import wire

SHOP = '''import os.path
import numpy as np
from .util import load, save as store
from json import *

LIMIT = 10
_ = None
rate: float = 0.5

def top(a, b=1) -> int:
    "one 'line'"
    def inner():
        return hidden()
    x = load(os.path.join(a, np.abs(b)))
    return len(x) + format(b)

def format(v):
    return store(v)

@register("cart")
class Cart(Base, metaclass=Meta):
    """Holds items.

    Second line.
    """
    SIZE = 3

    @property
    def total(self):
        return self.items.sum() + self.add(1).value()

    async def add(self, n):
        super().add(n)
        return top(make(n).wrap(self.total, check(n)), add)

    class Row:
        def key(self):
            return self.norm(Cart.total)

if True:
    def skipped():
        pass
'''


def parse(spark, **files):
    rows = [(k.replace("__", "/") + ".py", bytearray(v.encode())) for k, v in files.items()]
    return graph.parse_files(spark.createDataFrame(rows, "path string, content binary"))


def test_elements(spark):
    rows = graph.elements(parse(spark, pkg__shop=SHOP)).orderBy("elem_ord").collect()
    assert [(r.kind, r.scope_path, r.signature, r.line_start, r.line_end) for r in rows] == [
        ("constant", "LIMIT", "LIMIT = 10", 6, 6),
        ("constant", "_", "_ = None", 7, 7),
        ("function", "top", "def top(a, b=1) -> int", 10, 15),
        ("function", "format", "def format(v)", 17, 18),
        ("class", "Cart", "class Cart(Base, metaclass=Meta)", 21, 38),
        ("constant", "Cart > SIZE", "SIZE = 3", 26, 26),
        ("method", "Cart > total", "def total(self)", 29, 30),
        ("method", "Cart > add", "def add(self, n)", 32, 34),
        ("class", "Cart > Row", "class Row", 36, 38),
        ("method", "Cart > Row > key", "def key(self)", 37, 38),
    ]
    by = {r.scope_path: r for r in rows}
    assert by["top"].docstring == "one 'line"
    assert by["Cart"].docstring == "Holds items.\n\n    Second line."
    assert by["Cart"].decorators == ['@register("cart")']
    assert by["Cart > total"].decorators == ["@property"]
    assert by["Cart > add"].body.startswith("async def add(self, n):")
    assert (by["Cart > Row > key"].depth, by["Cart > Row > key"].parent_ord) == (2, 8)


def test_imports(spark):
    parsed = parse(spark, pkg__shop=SHOP)
    raw = [r.raw for r in graph.raw_imports(parsed).orderBy("import_ord").collect()]
    assert raw == [
        "import os.path", "import numpy as np", "from .util import load, save as store", "from json import *"
    ]
    rows = graph.graph_imports(parsed).orderBy("import_ord").collect()
    assert [(r.module, r.names, r.alias) for r in rows] == [
        ("os.path", [], None), ("numpy", [], "np"), (".util", ["load", "save"], None), ("json", ["*"], None)
    ]


def resolved(spark, source):
    rows = wire(parse(spark, f=source)).calls.orderBy("fn_ord", "call_ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r.caller, []).append((r.name, r.resolved))
    return out


def test_calls(spark):
    assert resolved(spark, SHOP) == {
        "top": [("load", ".util"), ("os.path.join", "os.path"), ("np.abs", "numpy")],
        "format": [("store", None)],
        "Cart.total": [("Cart.items.sum", "self")],
        "Cart.add": [("top", "local"), ("check", None)],
        "Row.key": [("Row.norm", "self")],
    }


def test_edges_and_statistics(spark):
    wired = wire(parse(spark, pkg__shop=SHOP))
    assert {(r.callee, r.caller) for r in wired.edges().collect()} == {
        ("Cart.items.sum", "Cart.total"), ("top", "Cart.add"), ("Row.norm", "Row.key")
    }
    assert graph.edge_count(wired.calls).first().edges == 3
    assert graph.file_stats(wired.stats()).first().asDict() == {
        "path": "pkg/shop.py", "functions": 5, "total_callers": 1, "total_calls": 8
    }
    assert [tuple(r) for r in wired.callers().collect()] == [("pkg/shop.py", "top", "Cart.add")]
    assert [tuple(r) for r in graph.callers_of(wired.edges(), "pkg/shop.py", "top").collect()] == [
        ("pkg/shop.py", "Cart.add")
    ]
    assert [tuple(r) for r in graph.callees_of(wired.functions, wired.calls, "pkg/shop.py", "Cart.add").collect()] == [
        ("top", "local"), ("check", None)
    ]


def test_tables_and_file_rows_agree(spark):
    parsed = parse(spark, pkg__shop=SHOP, b="def a():\n    self.x(); a(); a.b()\nclass a:\n    def x(self): self.x(a)\n", c="def (")
    wired = wire(parsed)
    by_file = graph.file_graphs(parsed).select("path", F.inline("functions"))
    assert sorted(map(str, wired.functions.collect())) == sorted(map(str, by_file.select(*wired.functions.columns).collect()))
    want = by_file.select("path", "fn_ord", F.posexplode("calls").alias("call_ord", "c")).select("path", "fn_ord", "call_ord", "c.*")
    assert sorted(map(str, wired.calls.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    contexts = {(r.path, r.fn_ord): ([c["name"] for c in r.calls], r.callers) for r in wired.contexts().collect()}
    assert contexts["b.py", 0] == (["self.x", "a", "a.b"], ["a"])
    assert contexts["b.py", 1] == (["a.x"], ["a.x"])


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_files_of_very_many_functions_need_little_memory(n, tmp_path):
    """A file of n functions that call each other, in a JVM of 1 GB."""
    script = tmp_path / "many.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
from codecairn.session import get_spark
from codecairn.operators import graph
from codecairn.operators.wiring import wire
spark = get_spark(master="local[2]", **{{"spark.driver.memory": "1g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
source = "".join(f"def f{{i}}(x):\\n    return f{{(i * 7) % {n}}}(x) + f{{i // 2}}(other(x))\\n" for i in range({n}))
wired = wire(graph.parse_files(spark.createDataFrame([("m.py", bytearray(source.encode()))], "path string, content binary")))
total = graph.file_stats(wired.stats()).first()
print("TOTAL", total.functions, total.total_calls, total.total_callers, wired.callers().count())
""")
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=400)
    i = range(n)
    calls = sum(1 + len({(k * 7) % n, k // 2}) for k in i)
    near = sum(len({(k * 7) % n, k // 2}) for k in i)
    assert out.stdout.split("TOTAL")[1].split() == [str(n), str(calls), str(near), str(near)], out.stderr[-2000:]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("import a.b\nimport c.d as e\ndef f():\n    a.x(); c.y(); e.z()\n",
         {"f": [("a.x", "a.b"), ("c.y", None), ("e.z", "c.d")]}),
        ("class K:\n    def m(self): pass\ndef f():\n    K.m(); K(); m()\n",
         {"f": [("K.m", None), ("K", "local"), ("m", "local")]}),
        ("def f():\n    g()(h)[k()](p(q()))\n", {"f": [("p", None), ("q", None)]}),
        ("def f():\n    (f)(); (a.b)(); (a).b()\n", {}),
        ("def f():\n    @deco(arg())\n    def g(x=dflt()):\n        inner()\n    after()\n",
         {"f": [("deco", None), ("arg", None), ("after", None)]}),
        ("def f():\n    a() if b() else c()\n    {k(): v()}\n    g(*s(), k=t(), **u())\n",
         {"f": [("a", None), ("b", None), ("c", None), ("k", None), ("v", None), ("g", None), ("s", None),
                ("t", None), ("u", None)]}),
        ("from m import x\nfrom n import x\ndef f():\n    x()\n    x()\n", {"f": [("x", "n")]}),
        ("def f():\n    self.go(); cls.go()\n", {"f": [("self.go", "self"), ("cls.go", None)]}),
        ("def f():\n    return f'{g(1)!r:>{w()}}' + ''.join(i() for i in j())\n",
         {"f": [("g", None), ("w", None), ("i", None), ("j", None)]}),
        ("def f():\n    lambda y=d(): e(y)\n    with o() as z, p2(): pass\n",
         {"f": [("d", None), ("e", None), ("o", None), ("p2", None)]}),
    ],
)
def test_call_rules(spark, source, want):
    got = resolved(spark, source)
    if "i() for" in source:  # a call on a literal has no name, and its arguments are read
        got["f"].sort(key=lambda c: "gwij".index(c[0]))
    assert got == want


def test_duplicate_names_share_callers(spark):
    source = "def a():\n    pass\ndef a():\n    b()\ndef b():\n    a()\n"
    wired = wire(parse(spark, f=source))
    rows = [tuple(r)[2:] for r in wired.stats().orderBy("fn_ord").collect()]
    assert rows == [("a", 0, 1), ("a", 1, 1), ("b", 1, 1)]
    # only the first definition counts, and that one calls nothing
    assert graph.callees_of(wired.functions, wired.calls, "f.py", "a").collect() == []
    assert [r.name for r in graph.callees_of(wired.functions, wired.calls, "f.py", "b").collect()] == ["a"]
    assert wired.callers().count() == 2


@pytest.mark.parametrize(
    ("header", "signature"),
    [
        ("def f(a: dict[str, int] = {'(': 1}, *, b=\")\") -> list[int]:", "def f(a: dict[str, int] = {'(': 1}, *, b=\")\") -> list[int]"),
        ("def f(a,  # note )\n      b):", "def f(a,  # note )\n      b)"),
        ("def f[T](x: T) -> (T):", "def f(x: T) -> (T)"),
        ("async def f():", "def f()"),
        ("def f(é='ü') -> 'ß':", "def f(é='ü') -> 'ß'"),
        ("class f:", "class f"),
        ("class f():", "class f()"),
        ("class f[T](Base[T], k=(1)):", "class f(Base[T], k=(1))"),
    ],
)
@pytest.mark.parametrize("body", ["\n    pass\n", "\n    @d\n    def g(): pass\n", " pass\n"])
def test_signatures(header, signature, body):
    if body == " pass\n" and "#" in header:
        body = "\n    pass\n"
    facts = file_facts((header + body).encode())
    assert facts["error"] is None
    assert facts["elements"][0]["signature"] == signature


@pytest.mark.parametrize(
    ("text", "docstring"),
    [
        ('"""a\n   b"""', "a\n   b"), ("'''x'''", "x"), ('"x\'"', "x"), ('r"""doc"""', 'r"""doc'),
        ('b"x"', 'b"x'), ('f"x{1}"', 'f"x{1}'), ('"a" "b"', None), ('("a")', None), ("1", None), ('"""  """', ""),
    ],
)
def test_docstrings(text, docstring):
    facts = file_facts(f"def f():\n    {text}\n".encode())
    assert facts["elements"][0]["docstring"] == docstring


def test_constants():
    source = "A = B = 1\nC: int\nD += 1\nE, F = 1, 2\nG.H = 1\nlower = 1\n_1 = 2\n(I) = 3\nÄ = 1\n"
    names = [e["name"] for e in file_facts(source.encode())["elements"]]
    assert names == ["A", "C", "_1", "Ä"]


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("bom", ["", "﻿"])
def test_byte_ranges(newline, bom):
    source = (bom + "é = 'ü'\nÉ = 'ü'\ndef f():\n    return 'ß'\n").replace("\n", newline).encode()
    facts = file_facts(source)
    texts = [source[e["start"] : e["start"] + e["length"]].decode() for e in facts["elements"]]
    assert texts == ["É = 'ü'", f"def f():{newline}    return 'ß'"]


@pytest.mark.parametrize("source", [b"def (", b"\xff\xfe", b"x = 'a\x00'", b"(" * 400 + b")" * 400])
def test_unreadable_files_give_an_error_row(source):
    facts = file_facts(source)
    assert facts["error"] and not facts["elements"]


def test_empty_file(spark):
    parsed = parse(spark, a="", b="def (")
    assert graph.elements(parsed).count() == 0
    assert [tuple(r) for r in graph.parse_errors(parsed).collect()] == [("b.py", "SyntaxError")]


def test_code_chunks(spark):
    elements = graph.elements(parse(spark, pkg__shop=SHOP))
    rows = chunks.chunk_code(elements).orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in rows] == [2, 3, 4, 6, 7, 8, 9]
    assert (rows[0].char_start, rows[0].char_end) == (10, 15)
    assert rows[1].embed_text == "pkg/shop.py > format\ndef format(v):\n    return store(v)"
    first = chunks.code_documents(chunks.chunk_code(elements)).first()
    assert (first.doc_type, first.title, len(first.content_hash)) == ("code", "", 12)


def test_skeleton_and_bullets(spark):
    parsed = parse(spark, m='import a\nclass K(B):\n    """Doc."""\n    def m(self): pass\n')
    skeleton = responses.file_skeletons(parsed).first().skeleton
    assert skeleton == 'import a\n\nclass K(B)  """Doc."""\n  def m(self)'
    bullets = graph.elements(parsed).orderBy("elem_ord").select(
        responses.element_bullet(F.col("depth"), F.col("scope_path"), F.col("kind"), F.col("signature")).alias("b")
    )
    assert [r.b for r in bullets.collect()] == [
        "- **K** (class) — `class K(B)`", "  - **K > m** (method) — `def m(self)`"
    ]


def test_parse_runs_once_in_the_plan(spark):
    plan = graph.elements(parse(spark, f=SHOP))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_headers_and_decorators_are_read_as_the_tokenizer_reads_lines():
    from codecairn.functions.pyfacts import file_facts

    source = (
        'def f(a="<\u2028>x\x0c",\n b=1) -> int:\n    pass\n\n'
        "@(deco)\n@(a  # c\n )\n@x.y(1,\n 2)  # t\n@ (z)[0]\n@plain # c\nclass K:\n    @property\n    def q(self): return 1\n"
    )
    first, second, third = file_facts(source.encode())["elements"]
    assert first["signature"] == 'def f(a="<\u2028>x\x0c",\n b=1) -> int'
    assert second["decorators"] == ["@(deco)", "@(a  # c\n )", "@x.y(1,\n 2)", "@ (z)[0]", "@plain"]
    assert third["decorators"] == ["@property"] and third["signature"] == "def q(self)"
    for ending in ("\r\n", "\r"):
        assert file_facts(source.replace("\n", ending).encode())["elements"][1]["decorators"][0] == "@(deco)"
