"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelattice.llm import decontaminate, exact_dedup, language_id, language_model, minhash, mixing, quality, sharding, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_sharding": sharding.op3,
        "op4_quality": quality.op4,
        "op5_mixing": mixing.op5,
        "op6_substrings": substrings.op6,
        "op7_minhash": minhash.op7,
        "op8_language_id": language_id.op8,
        "op9_exact_dedup": exact_dedup.op9,
        "op10_language_model": language_model.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.OP5_SQL,
        "op7_minhash": minhash.OP7_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
    }
