"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, mixing, near_dup, pii, repetition, rule_ensemble, substring_dedup, url_trust


def queries() -> dict:
    return {
        "op1_rule_ensemble": rule_ensemble.query,
        "op2_bpe_codec": bpe.encode_query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_url_trust": url_trust.query,
        "op5_near_dup": near_dup.query,
        "op6_token_counts": bpe.count_query,
        "op7_pii": pii.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_repetition_rules": repetition.query,
        "op10_source_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op4_url_trust": url_trust.ORACLE,
        "op9_repetition_rules": repetition.ORACLE,
        "op10_source_mixing": mixing.ORACLE,
    }
