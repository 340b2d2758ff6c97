"""The training-data queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from spanwright.llm import hard_negatives, html_extract, jaccard_join, line_dedup, lm_scoring, mixing, near_dup, packing, pii, quality_rules, spelling, topk_search, toxicity


def queries() -> dict:
    return {
        "op1_topk_search": topk_search.op1_topk_search,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_pii": pii.op4_pii,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_html_extraction": html_extract.op7_html_extraction,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_mixing": mixing.op10_mixing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_jaccard_join": jaccard_join.op12_jaccard_join,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_topk_search": topk_search.SQL,
        "op5_line_dedup": line_dedup.sql(),
        "op9_quality_rules": quality_rules.sql(),
        "op10_mixing": mixing.sql(),
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_jaccard_join": jaccard_join.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
