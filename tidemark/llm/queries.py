"""Queries of this package and their SQL, as ``__spark_entry__`` takes them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import (
    collocations,
    exact_dedup,
    fingerprints,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_dedup,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_packing": packing.op3_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_collocations": collocations.op12_collocations,
    "op13_fingerprints": fingerprints.op13_fingerprints,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
