"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe_encode, exact_dedup, line_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, url_filters, warc


def queries() -> dict:
    return {
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op5_bpe": bpe_encode.op5_bpe,
        "op7_packing": packing.op7_packing,
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op10_url_filter": url_filters.op10_url_filter,
        "op8_warc": warc.op8_warc,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op9_ngram_join": ngram_join.op9_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.SQL,
        "op3_quality_rules": quality_rules.SQL,
        "op1_line_dedup": line_dedup.SQL,
    }
