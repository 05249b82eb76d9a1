"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecairn.functions.text import content_hash
from codecairn.session import keyed, shuffle_width, spread

# One small Python file per part; positions: key, size, name, lower-case type.
PART_FILE = '''import os.path
import numpy as np
from .%4$s import load, save as store

LIMIT_%1$s = %2$s
rate = 0.5
%5$sdef price_%1$s(qty, rate=0.5) -> float:
    """Price of %3$s."""
    x = load(os.path.join(str(qty), np.abs(rate)))
    return helper_%1$s(x).wrap(check(x)) + len(x)

def helper_%1$s(v):
    return store(v)

@register("%3$s")
class Part%1$s(Base):
    SIZE = %2$s

    @property
    def total(self):
        return self.items.sum() + price_%1$s(1) + self.add(2)

    async def add(self, n):
        super().add(n)
        return helper_%1$s(price_%1$s(n))
'''


# One definition per order, by its status; positions: order, previous order, priority, year.
ORDER_CODE = {
    "F": '''def f_%1$s(a, b=%4$s):
    """Handles %3$s."""
    x = save(np.abs(a), len(b))
    return f_%2$s(x) + missing_%1$s(x) + save(b)

''',
    "O": '''@register("%3$s")
class K_%1$s(Base):
    YEAR = %4$s

    def run(self):
        return self.step(f_%2$s(1)) + self.run()

    async def step(self, n):
        super().add(n)
        return K_%1$s(n) or os.path.join(n, step_%2$s.go())

''',
    "P": "LIMIT_%1$s = %4$s  # %3$s after %2$s\n\n",
}
#: Of so many orders one lies in the common file.
COMMON = 10
#: The common file lies in sections of so many order keys.
SECTION = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, table).select(*columns))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: a Python file per part, padded by its size."""
    kind = F.lower("p_type")
    pad = F.repeat(F.concat(F.lit("# "), F.col("p_name"), F.lit("\n")), F.col("p_size"))
    source = F.format_string(
        PART_FILE, F.col("p_partkey"), F.col("p_size"), F.col("p_name"), kind, pad
    )
    path = F.concat_ws(
        "/",
        F.lit("src"),
        kind,
        F.replace("p_brand", F.lit("#"), F.lit("_")),
        F.concat(F.lit("part_"), F.col("p_partkey"), F.lit(".py")),
    )
    parts = read_spread(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return parts.select(path.alias("path"), F.encode(source, "UTF-8").alias("content"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, section, content)``: a Python file per customer with a definition per order.

    Files have none to dozens of definitions, one common file has a tenth of
    all and lies in sections.  Imports differ by nation, calls lead to neighbours in the file where
    those are functions, and files of customers in debt do not parse.
    """
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year")
    )
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    common = F.col("o_orderkey") % COMMON == 0
    placed = orders.join(keyed(customers), orders["o_custkey"] == customers["c_custkey"]).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "year",
        F.when(common, "pkg/common.py").otherwise(F.concat_ws("/", F.lit("pkg"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey", F.lit(".py")))).alias("path"),
        F.when(common, 0).otherwise(F.col("c_nationkey")).alias("nation"),
        (~common & (F.col("c_acctbal") < -900)).alias("broken"),
        F.when(common, F.floor(F.col("o_orderkey") / SECTION)).alias("section"),
    )
    # a section is dealt out by itself, so that no task has the common file whole
    dealt = placed.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), "path", "section")
    inside = F.lag("o_orderkey").over(Window.partitionBy("path", "section").orderBy("o_orderkey"))
    ends = placed.where(F.col("section").isNotNull()).groupBy("path", "section").agg(F.max("o_orderkey").alias("end"))
    earlier = F.lag("end").over(Window.partitionBy("path").orderBy("section"))
    linked = dealt.withColumn("inside", inside).join(keyed(ends.select("path", "section", earlier.alias("earlier"))), ["path", "section"], "left")
    before = F.coalesce("inside", "earlier")
    key, last = F.col("o_orderkey"), F.coalesce(before, "o_orderkey")
    code = F.coalesce(
        *(
            F.when(F.col("o_orderstatus") == status, F.format_string(text, key, last, F.col("o_orderpriority"), F.col("year")))
            for status, text in ORDER_CODE.items()
        )
    )
    coded = linked.select("path", "nation", "broken", "section", "o_orderkey", before.isNull().alias("first"), code.alias("code"))
    bodies = coded.groupBy("path", "nation", "broken", "section").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("o_orderkey", "code"))).alias("parts")
    )
    nation = F.col("nation").cast("string")
    head = F.concat(
        F.lit("import os.path\nimport numpy as np\nfrom .m"), nation, F.lit(" import load, save\n"),
        F.when(F.col("nation") % 2 == 0, F.lit("from .late import save\nfrom .star import *\n")).otherwise(F.lit("")), F.lit("\n"),
    )
    source = F.concat(
        F.when(F.col("first"), head).otherwise(F.lit("")),
        F.array_join(F.transform("parts", lambda p: p.code), ""),
        F.when(F.col("broken"), F.lit("def (\n")).otherwise(F.lit("")),
    )
    return bodies.select("path", "section", F.encode(source, "UTF-8").alias("content"))


def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: frontmatter title, one heading, lines as paragraphs."""
    text = F.concat(
        F.lit('---\ntitle: "'), F.col("source"), F.lit('"\nlang: '), F.col("lang"),
        F.lit("\n---\n\n# "), F.col("source"), F.lit("\n\n"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n"),
    )
    return read_spread(spark, sf_dir, "documents", "doc_id", "source", "lang", "text").select(
        F.lit("article").alias("doc_type"), F.col("doc_id").cast("string").alias("path"), text.alias("text")
    )


def turn_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a description with three heading levels."""
    text = F.concat(
        F.lit("Opening of "), F.col("conv_id"), F.lit(".\n\n# conversation "), F.col("conv_id"),
        F.lit("\n\n### aside\n\nBefore the turn.\n\n## "), F.col("role"), F.lit("\n\n### turn "),
        F.col("turn"), F.lit("\n\n"), F.col("text"), F.lit("\n\n## empty\n\n# end\nLast line of "),
        F.col("role"), F.lit(".\n"),
    )
    return read_spread(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(
        F.lit("description").alias("doc_type"),
        F.concat_ws("/", "conv_id", "turn").alias("path"),
        F.col("role"),
        F.col("turn"),
        text.alias("text"),
    )


def document_files(spark: SparkSession, sf_dir: str, directory: str = "source") -> DataFrame:
    """Documents seen as source files of a directory."""
    return read(spark, sf_dir, "documents").select(
        F.col(directory).alias("dir"),
        F.concat_ws("/", F.col(directory), F.col("doc_id")).alias("path"),
        "n_chars",
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as file paths: a ``www.`` host becomes a dotted folder, a
    page without an extension a Python file."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "/$", ""), r"^www\.", ".")
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.rlike(bare, F.lit(r"\.html$")), bare).otherwise(F.concat(bare, F.lit(".py"))).alias("path"),
        F.length("html").cast("long").alias("n_chars"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, text)``: a Python file per page, a seventh of all in one folder,
    some in folders or under names that a scan leaves out."""
    key = F.col("page_id")
    folder = (
        F.when(key % 13 == 0, F.concat(F.lit("d"), key % 11, F.lit("/tests")))
        .when(key % 17 == 0, F.lit(".hidden"))
        .when(key % 7 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("d"), key % 11, F.lit("/e"), key % 3))
    )
    ending = F.when(key % 19 == 0, F.lit(".txt")).otherwise(F.lit(".py"))
    return read(spark, sf_dir, "pages").select(
        F.concat(folder, F.lit("/__page_"), key, ending).alias("path"), F.col("html").alias("text")
    )


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), content_hash(F.col("text")).alias("source_hash")
    )


def described_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as described files; a low-quality one was described
    from another version of its text."""
    version = F.when(F.col("quality") == 1, F.col("hash")).otherwise(F.col("old_hash"))
    return _hashed_documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("path"), version.alias("source_hash")
    )


def _hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the hashes of two versions of their text, computed in the scan:
    joins carry hashes, not texts."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang",
        content_hash(F.col("text")).alias("hash"),
        content_hash(F.upper("text")).alias("old_hash"),
    )


def article_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and current ``(name, path, hash)`` of one article per source,
    language and quality; toxic documents have changed since, and documents of
    no label are new."""
    labelled = _hashed_documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    name = F.concat_ws("-", "source", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("new")))
    rows = labelled.select(
        name.alias("name"),
        F.col("doc_id").cast("string").alias("path"),
        "hash",
        "old_hash",
        "toxic",
    )
    stored = rows.where(F.col("toxic").isNotNull()).select(
        "name", "path", F.when(F.col("toxic") == 1, F.col("old_hash")).otherwise(F.col("hash")).alias("hash")
    )
    return stored, rows.select("name", "path", "hash")


# Fixed value: the first word of a line becomes a symbol heading.
ANSWER_HEAD = r"\n([A-Za-z]+)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generated answers: each line's first word heads a section."""
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("path"),
        F.regexp_replace("text", ANSWER_HEAD, "\n### `$1`\n").alias("response"),
    )


def answer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of labelled documents: the first word of every line after the first."""
    lines = (
        read(spark, sf_dir, "documents")
        .join(read(spark, sf_dir, "labels"), "doc_id")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("elem_ord", "line"))
    )
    word = F.regexp_extract("line", "^([A-Za-z]+)", 1)
    return lines.where((F.col("elem_ord") > 0) & (word != "")).select(
        F.col("doc_id").cast("string").alias("path"),
        word.alias("scope_path"),
        F.lit("function").alias("kind"),
        F.concat(F.lit("def "), word, F.lit("()")).alias("signature"),
        "elem_ord",
        F.col("elem_ord").alias("line_start"),
        (F.col("elem_ord") + F.length("line")).alias("line_end"),
    )


def flow_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flow lists: odd lines traced, even lines named."""
    paired = F.regexp_replace("text", r"\n([^\n]*)\n", "\nTRACE: $1\nFLOW: ")
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("path"),
        F.concat(F.lit("1. FLOW: "), paired, F.lit("\nTRACE: end")).alias("response"),
    )
