"""The pipeline against the same steps in plain Python."""

import corpus_pipeline
from pyspark.sql import functions as F

from codecairn.llm import line_dedup, pii, quality_rules

from test_near_and_lines import brute_lines
from test_near_text import brute
from test_tokens import check_packing, library

SF = "/root/testdata/sf0.01"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = quality_rules.trusted_documents(spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r.row for r in quality_rules.quality_rules(docs, trusted).where("kept").collect()]
    lines = brute_lines([(r.doc_id, r.text, r.source) for r in kept], line_dedup.MIN_SITES)
    first = {c for _, c in brute([(i, t or "") for i, t, _ in lines])}
    texts = {i: pii.mask(t or "", pii.all_spans(t or "")[1]) for i, t, _ in lines if i in first}
    ids = {i: [*e.ids, 2] for i, e in zip(texts, library("byte_bpe_50k.json").encode_batch(list(texts.values()), add_special_tokens=False))}
    check_packing(corpus_pipeline.run(spark, SF).collect(), ids, 1024)
    assert 0.6 * docs.count() < len(texts) < docs.count()


def test_clean_documents_pass_the_first_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = labels.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share"))
    share = {r.quality: r.share for r in told.collect()}
    assert share[1] > 0.9 and share[0] < 0.1


def test_stages_keep_columns_on_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs_after = stage(spark, docs, SF)
            assert docs_after.columns == edge_docs.columns
            assert [f.dataType for f in docs_after.schema] == [f.dataType for f in edge_docs.schema]
            assert docs_after.count() <= docs.count()
    assert corpus_pipeline.packing_stage(spark, edge_docs, SF).count() >= edge_docs.count()


def test_near_duplicate_stage_keeps_one_of_a_group(spark, edge_docs):
    rows = corpus_pipeline.near_duplicate_stage(spark, edge_docs, SF).collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    assert {1, 7, 9} <= set(ids) and not {2, 3, 8, 10} & set(ids)
