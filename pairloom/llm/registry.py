"""Queries and SQL of this package, for __spark_entry__.py."""

from __future__ import annotations

from pairloom.llm import exact_dedup, mixing, near_dedup, pieces, quality_classifier, quality_rules, secrets, sharding, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_secrets": secrets.op7_secrets,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_sharding": sharding.op9_sharding,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
