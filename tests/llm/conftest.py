import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Column names that the operators use inside, as extra columns of a table.
CLASHING = ("row", "words", "text_sha256", "candidate", "bucket", "hits", "fp", "length", "weights", "part")
FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
]


def edge_texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "two words"), (6, "  double  spaced   text \n\n end "),
        (7, long), (8, long), (9, "same text here twice over"), (10, "same text here twice over"),
        (10, "same text here twice over"), (None, "nameless text of the table"), (None, "nameless text of the table"),
        (11, "it's été naïve 你好 \U0001f600 1234 \x00 \x1c   don't"), (12, "́ combining é <|endoftext|> Å"),
        (13, "aaaa " * 50), (14, "x" * 5000), (15, "1" * 5000 + " " + "." * 300),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t), *("x" for _ in CLASHING)) for k, (i, t) in enumerate(edge_texts())]
    schema = T.StructType([*FIELDS, *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T.StructType([*FIELDS, *(T.StructField(c, T.StringType()) for c in CLASHING)]))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, sources=None, start=0):
        rows = [(start + i, t, "en", sources[i] if sources else f"src{i % 20}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, T.StructType(FIELDS)).repartition(4)

    return make


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}
