import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from conftest import CLASHING
from pyspark.sql import types as T

from codecairn.llm import lexical_search as search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, best=10):
    """Every document scored for every item, plainly."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(held, sizes):
            total = 0
            for w, q in Counter(terms(text)).items():
                if c[w]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    gain = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    total += q * gain * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if total > 0:
                scored.append((-total, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:best])]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def items_of(spark, rows):
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], schema)


QUERIES = [(1, "same text here"), (2, None), (3, ""), (4, "The naïve 你好 end text text"), (4, "two words"), (None, "nameless text"), (5, "w1x1 w2x2 absent"), (6, "é combining Å")]


def test_edge_cases(spark, edge_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = found(search.lexical_search(edge_docs, items_of(spark, QUERIES)))
    assert got == sorted(brute(docs, QUERIES), key=str)
    assert any(r[2] is None for r in got)


def test_empty_tables(spark, no_docs, edge_docs):
    assert found(search.lexical_search(no_docs, items_of(spark, QUERIES))) == []
    assert found(search.lexical_search(edge_docs, items_of(spark, []))) == []
    assert search.lexical_search(no_docs, items_of(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_blocks_and_small_shards(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(300)]
    asked = [(i, " ".join(rng.choices(words, k=12))) for i in range(20)]
    want = sorted(brute(list(enumerate(texts)), asked), key=str)
    monkeypatch.setattr(search, "BLOCK_BYTES", 300)
    monkeypatch.setattr(search, "SHARD_BYTES", 2000)
    assert found(search.lexical_search(make_docs(texts), items_of(spark, asked))) == want


def test_limited_accumulators_lose_nothing():
    rng = np.random.default_rng(3)
    stopped = 0
    for _ in range(300):
        n = int(rng.integers(5, 200))
        postings, gains, query = {}, [], []
        for t in range(int(rng.integers(1, 12))):
            df = int(rng.integers(1, n + 1))
            places = np.sort(rng.choice(n, df, replace=False))
            impacts = rng.integers(1, 50, df)
            postings[t] = (places, impacts, int(impacts.max()))
            query.append((df, t, int(rng.integers(0, 9000 // df + 1))))
        query.sort()
        gains = [g for *_, g in query]
        full = np.zeros(n, np.int64)
        for _, t, g in query:
            full[postings[t][0]] += g * postings[t][1]
        want = sorted((-s, i) for i, s in enumerate(full.tolist()) if s)[:10]
        where, scores = search.best_in_shard([t for _, t, _ in query], gains, postings, n, 10, np.arange(n))
        assert list(zip((-scores).tolist(), where.tolist())) == want
        stopped += len(want) == 10
    assert stopped > 50


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.sql(search.ORACLE).fetchall(), key=str)
    assert want and found(search.op13_ranked_search(spark, SF)) == want
