"""Quality rules and classifier."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecairn.llm import quality_classifier as qc
from codecairn.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words, windows = WORD.findall(text), {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rows_of(docs, trusted):
    return qr.quality_rules(docs, trusted).collect()


def check_counts(rows):
    for r in rows:
        text = r.row.text or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and round(r.score, 9) >= qr.THRESHOLD)


def test_counts(spark, documents, edge_docs, no_docs, make_docs):
    rnd = random.Random(0)
    texts = [" ".join(rnd.choices("abc", k=rnd.randint(0, 60))).replace(" b ", rnd.choice([" b\n", "\t\x0b", " b "])) for _ in range(300)]
    trusted = documents.select("doc_id").limit(50)
    for docs in (documents, edge_docs, make_docs(texts)):
        rows = rows_of(docs, trusted)
        assert len(rows) == docs.count()
        check_counts(rows)
    assert rows_of(no_docs, trusted) == []


def test_scores_are_length_normalised_ratios(spark, make_docs):
    """The score of each text from bucket counts gathered here."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["good", "plain", "text", "word"] if k % 2 else ["bad#", "worse|", "text"]) for _ in range(rnd.randint(1, 40))) for k in range(80)]
    docs = make_docs(texts)
    trusted = docs.where("doc_id % 2 = 1 and doc_id < 40").select("doc_id")
    rows = rows_of(docs, trusted)
    hashed = {r.doc_id: r.b for r in docs.select("doc_id", qr.words_of(docs.text).alias("w")).select("doc_id", qr._ngrams("w").alias("b")).collect()}
    raw, good = np.zeros(qr.BUCKETS), np.zeros(qr.BUCKETS)
    for i, b in hashed.items():
        np.add.at(raw, b, 1)
        if i % 2 == 1 and i < 40:
            np.add.at(good, b, 1)
    total, smooth = good.sum(), qr.SMOOTHING
    target = (good + smooth) / (total + smooth * qr.BUCKETS)
    corpus = (raw * total / raw.sum() + smooth) / (total + smooth * qr.BUCKETS)
    assert target.sum() == pytest.approx(1) and corpus.sum() == pytest.approx(1)
    log = np.log(target) - np.log(corpus)
    for r in rows:
        b = hashed[r.doc_id]
        assert len(b) == 2 * r.n_words - 1
        assert r.score == pytest.approx(log[b].sum() / (len(b) + qr.LENGTH_PRIOR), abs=1e-9)


def test_filtering_on_the_verdict_does_not_repeat_the_work(documents):
    """A filter on the verdict stays above the steps that prepare it."""
    kept = qr.quality_rules(documents, documents.select("doc_id")).where("kept").select("row.*")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4  # words and lines of the score, words of the counts


def test_clean_documents_stay(spark):
    """Labelled good and unlabelled clean documents are kept at every size, junk goes."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in qr.op6_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in rows.values() if not r.base_failed]
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1]
    junk = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    unknown = [r.kept for r in judged if r.doc_id not in labels]
    assert all(good) and np.mean(junk) < 0.1 and np.mean(unknown) > 0.9


def test_no_trusted_documents(documents):
    rows = rows_of(documents, documents.select("doc_id").limit(0))
    assert all(r.score == 0 for r in rows)


def test_plan_is_native(documents):
    plan = qr.quality_rules(documents, documents.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_statistics_are_finite(edge_docs):
    for r in edge_docs.collect():
        got = qc.statistics_of(r.text or "")
        assert len(got) == len(qc.STATISTICS) and all(map(math.isfinite, got))


def test_trees_learn_and_traverse():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = qc.fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    for row in x[:50]:  # walk each tree by hand
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        assert forest.raw(row[None])[0] == pytest.approx(total)


@pytest.mark.parametrize("y", [[], [1.0] * 30, [0.0] * 30])
def test_one_class_or_none(y):
    forest = qc.fit(np.zeros((len(y), 3)), np.array(y))
    score = forest.score(np.ones((2, 3)))
    assert score == pytest.approx([(sum(y) + 1) / (len(y) + 2)] * 2)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = qc.op7_quality_classifier(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [s for s, q in held if q == 1]
    bad = [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(rows) == 1000 and auc > 0.9
    assert np.mean([(s >= qc.CUT) == q for s, q in held]) > 0.9


def test_edges_are_scored(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (9, None)], "doc_id long, label int")
    forest = qc.train(edge_docs, labels)
    rows = qc.quality_scores(edge_docs, forest).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert qc.quality_scores(no_docs, qc.train(no_docs, labels)).count() == 0


def test_every_trusted_document_counts(spark):
    """Of 60,000 trusted documents none is left out of the target's counts."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    docs = docs.unionAll(spark.range(60_000, 60_100).select("id", F.lit("junk")))
    weights = qr.bucket_weights(docs, docs.where("doc_id < 60000").select("doc_id")).first().weights
    at = {r.text: r.b[0] for r in docs.select("text").distinct().select("text", qr._ngrams(qr.words_of(F.col("text"))).alias("b")).collect()}
    # 8,572 texts with the word, all of them trusted; the raw counts are scaled by 60,000 / 60,100
    n = 8572
    assert weights[at["w0"]] == pytest.approx(math.log((n + qr.SMOOTHING) / (n * 60_000 / 60_100 + qr.SMOOTHING)), abs=1e-9)


def test_trusted_rows_are_those_of_the_ids(spark, documents):
    ids = [r.doc_id for r in documents.select("doc_id").collect()]
    for given in (ids[::3], ids[:1], [], [None, ids[0], ids[0], -5]):
        trusted = spark.createDataFrame([(i,) for i in given], "doc_id long")
        got = [r.doc_id for r in qr.trusted_rows(documents, trusted).collect()]
        assert sorted(got) == sorted(i for i in ids if i in set(given))


def test_characters_are_counted_without_a_look_up_each(spark):
    """And windows are hashed from the hashes of their words, so that no word is read five times."""
    texts = ["a#b *  c d\x0b|\r\n", "#*$%&|<>", " \t\n", "", "one two three four five " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = qr.quality_rules(docs, docs.where("doc_id = 4").select("doc_id"))
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "hashes" in plan
    got = {r.doc_id: (r.word_chars, r.n_symbols, r.n_repeat_words) for r in rules.collect()}
    assert got == {0: (8, 3, 0), 1: (8, 8, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (57, 0, 15)}
