"""Queries of this folder and of the pipeline, with SQL where it can express them on whole tables."""

from __future__ import annotations

from corpusflow.llm import decontamination, hard_negatives, html_extraction, language_id, license_scan, line_dedup, lm_scoring, mixing, packing, quality_rules, simhash, substring_dedup, whitening


def queries() -> dict:
    found = {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_html_extraction": html_extraction.op2_html_extraction,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_simhash_neardup": simhash.op5_simhash_neardup,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_language_id": language_id.op7_language_id,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
        "op10_packing": packing.op10_packing,
        "op11_mixing": mixing.op11_mixing,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_whitening": whitening.op13_whitening,
    }
    return found


def oracle_sql() -> dict:
    return {"op1_license_scan": license_scan.oracle(), "op3_substring_dedup": substring_dedup.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
