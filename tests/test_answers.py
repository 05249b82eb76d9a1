"""Generated answers, staleness, rendering."""

import pytest
from pyspark.sql import functions as F

from codecairn.operators import prompts, responses, staleness
from codecairn.functions.text import flow_file_name, frontmatter_sources, module_file_name

ELEMENTS = [
    ("f", s, o, k, None, a, b)
    for o, (s, k, a, b) in enumerate(
        [("LIMIT", "constant", 6, 6), ("top", "function", 10, 15), ("Cart", "class", 21, 38), ("top", "function", 40, 41)]
    )
]


def elements(spark):
    return spark.createDataFrame(
        ELEMENTS, "path string, scope_path string, elem_ord int, kind string, signature string, line_start int, line_end int"
    )


def answer(spark, text):
    return spark.createDataFrame([("f", text)], "path string, response string")


def test_symbols_and_missing(spark):
    df = answer(spark, "Summary.\n\n### `top`\n\nText A\n### ghost\nText B\n### `Cart`\n\n")
    assert df.select(responses.response_summary(F.col("response"))).first()[0] == "Summary."
    symbols = responses.response_symbols(df)
    rows = responses.match_symbols(symbols, elements(spark)).orderBy("sym_ord").collect()
    # the later of two same-named elements gives the facts
    assert [(r.scope_path, r.kind, r.line_start, r.line_end, r.description) for r in rows] == [
        ("top", "function", 40, 41, "Text A"), ("ghost", "unknown", 0, 0, "Text B")
    ]
    missing = responses.missing_elements(elements(spark), symbols).orderBy("elem_ord").collect()
    assert [r.scope_path for r in missing] == ["LIMIT", "Cart"]


def test_other_headings_are_summary(spark):
    df = answer(spark, "# A\n## b\n#### c\n###d\n")
    assert responses.response_symbols(df).count() == 0
    assert df.select(responses.response_summary(F.col("response"))).first()[0] == "# A\n## b\n#### c\n###d"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("FLOW: Top-K Search\nTRACE: uses foo_bar", [("TopK Search", "uses foobar")]),
        ("1. FLOW: x\nTRACE: y", [("x", "y")]),
        ("1. **FLOW:** x\nTRACE: y", []),
        ("TRACE: y", []),
        ("flow: a\nflow: b\nnoise\ntrace: c\ntrace: d", [("b", "c")]),
        ("FLOW:\nTRACE: y\nFLOW: z\nTRACE:", [("z", "")]),
        ("FLOW: `a`\nTRACE: **b**", [("a", "b")]),
    ],
)
def test_flows(spark, text, want):
    got = answer(spark, text).select(responses.flows(F.col("response")).alias("f")).first().f
    assert [tuple(x) for x in got] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("verdict: yes, big", True), ("VERDICT: NO", False), ("hmm", True), ("", True), (" x\n Verdict: no\nVERDICT: YES", False)],
)
def test_verdicts(spark, text, want):
    assert answer(spark, text).select(responses.verdict(F.col("response"))).first()[0] is want


def test_token_budget(spark):
    df = spark.createDataFrame([(0,), (41,), (100,), (500,)], "n int")
    got = [r[0] for r in df.orderBy("n").select(responses.max_tokens(F.col("n"))).collect()]
    assert got == [4096, 4100, 10000, 16384]


def test_description_rendering(spark):
    symbols = F.array(
        F.struct(
            F.lit("a > b").alias("scope_path"), F.lit("method").alias("kind"), F.lit("def b()").alias("signature"),
            F.lit("Does.").alias("description"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"),
        ),
        F.struct(
            F.lit("c").alias("scope_path"), F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("signature"),
            F.lit("Is.").alias("description"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"),
        ),
    )
    text = responses.description_markdown(
        F.lit("p.py"), F.lit("Sum."), symbols, F.lit("abc"), F.lit(""), F.lit("m")
    )
    assert spark.range(1).select(text).first()[0] == (
        '---\nsource: p.py\nsource_hash: abc\nmodel: m\nsymbols:\n  - scope_path: "a > b"\n    kind: method\n'
        '    lines: 1-2\n  - scope_path: "c"\n    kind: unknown\n    lines: 0-0\n---\n\n# p.py\n\nSum.\n\n'
        "## `a > b` — `def b()`\n\nDoes.\n\n## `c`\n\nIs.\n"
    )


def test_article_rendering_round_trip(spark):
    sources = F.array(
        F.struct(F.lit("a.py").alias("path"), F.lit("12ab").alias("hash")),
        F.struct(F.lit("b/c.py").alias("path"), F.lit("34cd").alias("hash")),
    )
    article = responses.article_markdown(
        F.lit("T"), F.lit("Body."), F.lit("flow"), sources, F.lit(""), F.lit("c0ffee1"), F.lit(True)
    )
    row = spark.range(1).select(article.alias("t")).select("t", frontmatter_sources(F.col("t")).alias("s")).first()
    assert row.t == (
        '---\ntitle: "T"\ntype: flow\ncommit: c0ffee1\ncommit_dirty: true\nsources:\n  a.py: 12ab\n  b/c.py: 34cd\n'
        "---\n\n# T\n\nBody.\n"
    )
    assert [tuple(x) for x in row.s] == [("a.py", "12ab"), ("b/c.py", "34cd")]


def test_file_names(spark):
    df = spark.createDataFrame([("a/b\\c",), (".",)], "d string")
    assert [r[0] for r in df.select(module_file_name(F.col("d"))).collect()] == ["a_b_c", "_root"]
    assert spark.range(1).select(flow_file_name(F.lit("Main Work"))).first()[0] == "flow-main-work"


STORED = {"a": "1", "b": "2"}


@pytest.mark.parametrize(
    ("stored", "current", "force", "stale"),
    [
        (STORED, STORED, False, False),
        (STORED, {"a": "1", "b": "3"}, False, True),
        (STORED, {"a": "1"}, False, True),
        (STORED, {**STORED, "c": "3"}, False, True),
        ({}, STORED, False, True),
        ({}, {}, False, True),
        (STORED, STORED, True, True),
    ],
)
def test_article_staleness(spark, stored, current, force, stale):
    def rows(d):
        return spark.createDataFrame([("n", k, v) for k, v in d.items()], "name string, path string, hash string")

    names = spark.createDataFrame([("n",)], "name string")
    status = staleness.article_status(rows(stored), rows(current), names, force)
    assert status.collect() == [("n", stale)]
    assert staleness.any_stale(status).first().any_stale is stale


def test_description_staleness(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, source_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, source_hash string")
    stale = staleness.stale_descriptions(files, known)
    assert sorted(r.path for r in stale.collect()) == ["b", "c"]
    assert staleness.stale_descriptions(files, known, force=True).count() == 3
    counts = staleness.action_counts(staleness.description_actions(files, known)).first()
    assert (counts.cached, counts.generated) == (1, 2)


def test_long_files_come_in_pieces(spark):
    df = spark.createDataFrame(
        [("d", "a.py", "python", "x" * 25), ("d", "b.py", "python", "y" * 10), ("d", "c.py", "python", "")],
        "dir string, path string, language string, source string",
    )
    rows = prompts.file_pieces(df, 10).orderBy("path", "piece").collect()
    assert [(r.path, r.piece, r.n_pieces) for r in rows] == [("a.py", 0, 3), ("a.py", 1, 3), ("a.py", 2, 3), ("b.py", 0, 1), ("c.py", 0, 1)]
    assert "a.py (part 3 of 3)" in rows[2].block and "x" * 5 in rows[2].block and "b.py\n" in rows[3].block
    assert prompts.significance_prompt("T", "text", "d" * 40_000).count("d" * 40_000) == 1


class Echo:
    """A store whose provider answers with the start of what it was asked."""

    def __init__(self):
        self.asked = []

    def answer(self, asked, keys, model, force=False):
        self.asked.append(asked.collect())
        return asked.select(*keys, F.substring(F.split("prompt", "follows.")[1], 3, 12).alias("response"))


def test_digests_reduce_in_levels(spark):
    from codecairn.plans.digest import digests

    rows = [("big", f"f{k:03}", f"<{k:03}>" + "z" * 35) for k in range(40)] + [("small", "a", "alpha"), ("small", "b", "beta"), ("long", "x", "q" * 250)]
    parts = spark.createDataFrame(rows, "key string, path string, text string")
    store = Echo()
    found = {r.key: r.text for r in digests(store, parts, F.lit("it"), "p", "m", False, limit=100).collect()}
    assert found["small"] == "alpha\nbeta"  # small enough: as it stands
    assert set(found) == {"big", "small", "long"} and all(len(t) <= 110 for t in found.values())
    assert len(store.asked) > 1 and len(store.asked[0]) == 20 + 3
    assert all(len(p.prompt) < 400 for level in store.asked for p in level)
    everything = "".join(p.prompt for p in store.asked[0])
    assert all(f"<{k:03}>" in everything for k in range(40)) and everything.count("q") >= 250
