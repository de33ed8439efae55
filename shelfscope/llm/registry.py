"""Names of the registered queries and their DuckDB SQL, where SQL can express one."""

from __future__ import annotations

from shelfscope.llm import (byte_bpe, decontamination, license_scan, lm_scoring, near_duplicates, pii, quality_classifier,
                            quality_rules, sharding, source_divergence, toxicity, vector_codes, vector_search)

QUERIES = {f.__name__: f for f in (
    lm_scoring.op1_lm_scoring,
    decontamination.op2_decontamination,
    toxicity.op3_toxicity,
    sharding.op4_sharding,
    license_scan.op5_license_scan,
    byte_bpe.op6_byte_bpe,
    pii.op7_pii,
    quality_rules.op8_quality_rules,
    quality_classifier.op9_quality_classifier,
    near_duplicates.op10_near_duplicates,
    vector_codes.op11_vector_codes,
    vector_search.op12_exact_search,
    source_divergence.op13_source_divergence,
)}

ORACLE: dict[str, str] = {
    "op2_decontamination": decontamination.SQL,
    "op5_license_scan": license_scan.SQL,
    "op10_near_duplicates": near_duplicates.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_exact_search": vector_search.SQL,
    "op13_source_divergence": source_divergence.SQL,
}
