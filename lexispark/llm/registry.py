"""Queries and SQL twins of this subpackage's operators, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import chat, decontamination, near_dup, packing, quality_classifier, quality_rules, sharding, substring_dedup, suffix_array_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_suffix_array_dedup": suffix_array_dedup.query,
        "op4_near_dup": near_dup.query,
        "op5_token_counts": token_counts.query,
        "op6_quality_rules": quality_rules.query,
        "op7_decontamination": decontamination.query,
        "op8_packing": packing.query,
        "op9_sharding": sharding.query,
        "op10_chat_formatting": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op3_suffix_array_dedup": suffix_array_dedup.ORACLE,
        "op4_near_dup": near_dup.ORACLE,
        "op10_chat_formatting": chat.ORACLE,
    }
