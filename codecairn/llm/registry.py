"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codecairn.llm import (
    exact_dedup,
    lexical_search,
    line_dedup,
    lm_scoring,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    spelling,
    token_counts,
    token_files,
    word_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_token_files": token_files.op2_token_files,
        "op3_word_bpe": word_bpe.op3_word_bpe,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_pii": pii.op10_pii,
        "op11_lm_scores": lm_scoring.op11_lm_scores,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_ranked_search": lexical_search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op13_ranked_search": lexical_search.ORACLE,
    }
