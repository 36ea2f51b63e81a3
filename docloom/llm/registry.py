"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import (
    alignment, decontam, html_text, licenses, near_duplicates, packing, quality_model, quality_rules, secrets, source_audit, substrings,
    token_files, toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_html_text": html_text.op3_html_text,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality_model": quality_model.op5_quality_model,
        "op6_token_files": token_files.op6_token_files,
        "op7_near_duplicates": near_duplicates.op7_near_duplicates,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_packing": packing.op9_packing,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_source_audit": source_audit.op11_source_audit,
        "op12_substring_dedup": substrings.op12_substring_dedup,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op2_decontamination": decontam.OP2_SQL,
        "op10_license_scan": licenses.OP10_SQL,
        "op11_source_audit": source_audit.OP11_SQL,
    }
