"""Markdown and code chunking: goldens, and a plain restatement on random input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codecairn.functions.packing import pack_paragraphs
from codecairn.functions.text import (
    extract_section,
    frontmatter_body,
    frontmatter_field,
    frontmatter_raw,
    frontmatter_scalars,
    frontmatter_sources,
)
from codecairn.operators.chunks import chunk_markdown, kb_documents, with_sections

DOCS = {
    "M1": '---\ntitle: "Guide"\n---\n\nPreamble text.\n\n# Guide\n\n## Setup\n\nInstall it.\n\n### Linux\n\n'
    "Use make.\n\n## Empty\n\n## Notes\n\n```sh\n# fenced\nls\n```\n",
    "M2": "No headings here.\n\nTwo paragraphs.\n",
    "M3": "# Big\n\n" + "\n\n".join(["a" * 1400, "b" * 200, "c" * 1600, "d" * 10]),
    "M4": "## \n\ntext\nmore\n",
    "M5": "---\njust a rule\n---\n\n# T\n\nbody\n",
    "M6": "# A\n### C\nx\n## B\ny\n# Z\nz\n",
    "M7": "  \n\n \n",
}

EXPECTED = [
    ("M1", "", "Preamble text.", 0, 16),
    ("M1", "Guide > Setup", "Install it.", 34, 48),
    ("M1", "Guide > Setup > Linux", "Use make.", 58, 70),
    ("M1", "Guide > Notes", "```sh", 89, 96),
    ("M1", "fenced", "ls\n```", 105, 111),
    ("M2", "", "No headings here.\n\nTwo paragraphs.", 0, 35),
    ("M3", "Big (part 1)", "a" * 1400, 7, 1407),
    ("M3", "Big (part 2)", "b" * 200, 1409, 1609),
    ("M3", "Big (part 3)", "c" * 1600, 1611, 3211),
    ("M3", "Big (part 4)", "d" * 10, 3213, 3223),
    ("M4", "text", "text\nmore", 4, 15),
    ("M5", "T", "body", 4, 9),
    ("M6", "A > C", "x", 10, 12),
    ("M6", "A > B", "y", 17, 19),
    ("M6", "Z", "z", 23, 25),
]


def frame(spark, docs):
    return spark.createDataFrame(
        [("article", k, v) for k, v in docs.items()], "doc_type string, path string, text string"
    )


def test_goldens(spark):
    rows = chunk_markdown(frame(spark, DOCS)).orderBy("path", "chunk_ord").collect()
    assert [(r.path, r.heading, r.content, r.char_start, r.char_end) for r in rows] == EXPECTED
    by_doc = {r.path: r.embed_text for r in rows if r.chunk_ord == 1}
    assert by_doc["M1"] == "Guide\nGuide > Setup\nInstall it."


def brute_chunks(body, limit=3000, target=1500):
    heads = [
        (m.start(), len(m.group(1)), m.group(2).strip())
        for m in re.finditer(r"^(#{1,6})\s+(.+)$", body, re.MULTILINE)
    ]
    if not heads:
        return [("", body.strip(), 0, len(body))] if body.strip() else []
    out, path = [], []
    if body[: heads[0][0]].strip():
        out.append(("", body[: heads[0][0]].strip(), 0, heads[0][0]))
    for i, (pos, level, label) in enumerate(heads):
        end = heads[i + 1][0] if i + 1 < len(heads) else len(body)
        path = [p for p in path if p[0] < level] + [(level, label)]
        heading = " > ".join(p[1] for p in path)
        line = body.find("\n", pos)
        line = len(body) if line < 0 else line
        content = body[line + 1 : end].strip()
        if not content:
            continue
        if len(content) <= limit:
            out.append((heading, content, line + 1, end))
            continue
        under = body[line + 1 : end]
        base = line + 1 + len(under) - len(under.lstrip())
        packs = brute_packs(content, target)
        done = 0
        for j, pack in enumerate(packs):
            label = f"{heading} (part {j + 1})" if len(packs) > 1 else heading
            first = None
            for para in pack.split("\n\n"):
                at = content.index(para, done)  # paragraphs come in order and never overlap
                first = at if first is None else first
                done = at + len(para)
            out.append((label, pack, base + first, base + done))
    return out


def brute_packs(text, target):
    packs, used = [[]], 0
    for para in filter(None, (p.strip() for p in re.split(r"\n\n+", text))):
        if packs[-1] and used + len(para) > target:
            packs.append([])
            used = 0
        packs[-1].append(para)
        used += len(para)
    return ["\n\n".join(p) for p in packs if p]


def random_body(rng):
    words = ["alpha", "βeta", "#tag", "x" * 700, "---", " pad ", "`code`", "12.", "", " "]
    lines = []
    for _ in range(rng.randint(0, 40)):
        kind = rng.random()
        if kind < 0.3:
            lines.append("#" * rng.randint(1, 8) + rng.choice([" ", "  ", "\t", ""]) + rng.choice(words))
        elif kind < 0.5:
            lines.append("")
        else:
            lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))))
    return "\n".join(lines)


def test_random_documents(spark):
    rng = random.Random(7)
    docs = {f"d{i}": "x" + random_body(rng) for i in range(300)}
    got = {}
    for r in chunk_markdown(frame(spark, docs)).orderBy("path", "chunk_ord").collect():
        got.setdefault(r.path, []).append((r.heading, r.content, r.char_start, r.char_end))
    for name, text in docs.items():
        assert got.get(name, []) == brute_chunks(text), name


def test_random_packing(spark):
    rng = random.Random(3)
    texts = [
        "\n\n".join("p" * rng.choice([0, 1, 10, 400, 900, 1500, 1501]) for _ in range(rng.randint(0, 25)))
        for _ in range(100)
    ]
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        .select("i", pack_paragraphs(F.col("t"), 1500).alias("p"))
        .collect()
    )
    for r in rows:
        assert [p.content for p in r.p] == brute_packs(texts[r.i], 1500)
        for p in r.p:
            assert "".join(texts[r.i][p.start : p.end].split()) == "".join(p.content.split())


def test_repeated_openings_have_their_own_offsets(spark):
    para = "the same opening of every paragraph, longer than fifty characters " + "x" * 1400
    text = "# T\n\n" + "\n\n\n".join([para] * 4) + "\n"
    rows = chunk_markdown(frame(spark, {"a": text})).orderBy("chunk_ord").collect()
    assert [text[r.char_start : r.char_end] for r in rows] == [para] * 4
    assert [r.char_start for r in rows] == [5 + k * (len(para) + 3) for k in range(4)]


@pytest.mark.parametrize("kind", ["headings", "long", "sources"])
def test_large_documents_take_linear_time(spark, kind):
    """100,000 headings, 20 MB in one section, 100,000 source lines: seconds each."""
    if kind == "sources":
        text = "---\ntitle: T\nsources:\n" + "".join(f"  f/{k % 99_000}.py: {k:012x}\n" for k in range(100_000)) + "---\nbody\n"
        df = spark.createDataFrame([(text,)], "text string")
        found = df.select(frontmatter_sources(F.col("text")).alias("s")).first().s
        assert len(found) == 99_000 and found[0].path == "f/1000.py" and found[-1].hash == f"{99_999:012x}"
        return
    if kind == "headings":
        text = "".join(f"{'#' * (1 + k % 4)} h{k}\ntext {k}\n" for k in range(100_000))
    else:
        text = "# T\n\n" + "\n\n".join(f"paragraph {k} " + "word " * 40 for k in range(100_000))
    rows = chunk_markdown(frame(spark, {"a": text})).agg(F.count("*"), F.max("char_end"), F.max("heading")).first()
    assert rows[0] == 100_000 if kind == "headings" else rows[0] > 10_000
    assert rows[1] >= len(text.rstrip())


def test_no_shuffle_in_chunking(spark):
    plan = chunk_markdown(frame(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_frontmatter(spark):
    text = '---\ntitle: "T"\nsources:\n  a.py: 12ab\n  b/c.py: 34cd\nmodel: m\n---\n\n# T\n\nbody --- end\n'
    df = spark.createDataFrame([(text,), ("plain --- text\n",), ("--- open",)], "text string")
    rows = df.select(
        frontmatter_field(frontmatter_raw(F.col("text")), "title").alias("title"),
        frontmatter_body(F.col("text")).alias("body"),
        frontmatter_sources(F.col("text")).alias("sources"),
        frontmatter_scalars(F.col("text")).alias("scalars"),
    ).collect()
    assert rows[0].title == "T" and rows[0].body == "# T\n\nbody --- end"
    assert [tuple(s) for s in rows[0].sources] == [("a.py", "12ab"), ("b/c.py", "34cd")]
    # lines are stripped before the indentation is looked at, so sources leak in
    assert rows[0].scalars == {"title": "T", "sources": "", "a.py": "12ab", "b/c.py": "34cd", "model": "m"}
    assert rows[1].body == "plain --- text\n" and rows[1].title == "" and rows[1].scalars == {}
    assert rows[2].body == "--- open"


@pytest.mark.parametrize(
    ("raw", "title"),
    [("title: 'A'", "A"), ("title: A b", "A b"), ("title:", ""), ("other: x", ""), ('title: "a"b', '"a"b')],
)
def test_title_forms(spark, raw, title):
    df = spark.createDataFrame([(f"---\n{raw}\n---\nbody",)], "text string")
    assert df.select(frontmatter_field(frontmatter_raw(F.col("text")), "title")).first()[0] == title


def test_sections_of_a_description(spark):
    text = (
        "# p/graph.py\n\nSummary.\n\n## `build` — `def build()`\n\nBuilds.\n\n### deeper\n\nMore.\n\n"
        "## `rebuild`\n\nAgain.\n\n## `Cart > add`\n\nAdds.\n"
    )
    df = spark.createDataFrame(
        [(s,) for s in ("build", "rebuild", "Cart.add", "Cart > add", "graph", "nope", "eep")], "s string"
    )
    got = {r.s: r.t for r in df.select("s", extract_section(F.lit(text), F.col("s")).alias("t")).collect()}
    assert got["build"] == "## `build` — `def build()`\n\nBuilds.\n\n### deeper\n\nMore."
    assert got["rebuild"] == "## `rebuild`\n\nAgain."
    assert got["Cart.add"] == got["Cart > add"] == "## `Cart > add`\n\nAdds."
    assert got["graph"] == text.strip()
    assert got["eep"] == "### deeper\n\nMore."
    assert got["nope"] is None


def test_documents_keyed_by_type_and_path(spark):
    df = spark.createDataFrame(
        [("article", "a.md", "x"), ("description", "a.md", "x")], "doc_type string, path string, text string"
    )
    rows = kb_documents(df).collect()
    assert {(r.doc_type, r.path) for r in rows} == {("article", "a.md"), ("description", "a.md")}
    assert {r.content_hash for r in rows} == {"2d711642b726"}


def test_section_spans_cover_the_body(spark):
    rng = random.Random(11)
    docs = {f"d{i}": "x" + random_body(rng) for i in range(60)}
    for r in with_sections(frame(spark, docs)).collect():
        at = len(r.lead)
        for s in r.sections:
            assert s.pos == at
            at = s.section_end
        assert at == len(r.body)
