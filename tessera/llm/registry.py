"""Queries of this subpackage, one for each operator."""

from __future__ import annotations

from tessera.llm import decontamination, exact_dedup, langid, lm, packing, quality, simhash, substrings, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_language_id": langid.op2_language_id,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_lm_scoring": lm.op4_lm_scoring,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_simhash": simhash.op6_simhash,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict:
    return {"op8_exact_dedup": exact_dedup.OP8_SQL}
