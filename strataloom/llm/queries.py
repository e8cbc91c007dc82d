"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, contracts, decontaminate, fingerprints, licenses, line_dedup, mixing, near_dedup, pii, quality, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_personal_data": pii.op8_personal_data,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
    **contracts.QUERIES,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op6_minhash_near_dedup": contracts.NEAR_SQL,
    **contracts.ORACLES,
}
