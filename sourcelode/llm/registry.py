"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    bpe,
    exact_dedup,
    language_id,
    license_scan,
    media_columns,
    packing,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_language_id": language_id.query,
    "op3_simhash": simhash.query,
    "op4_bpe": bpe.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_token_counts": token_counts.query,
    "op7_packing": packing.query,
    "op8_sharding": sharding.query,
    "op9_media_columns": media_columns.query,
    "op10_toxicity": toxicity.query,
}
ORACLES = {"op1_license_scan": license_scan.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE}
