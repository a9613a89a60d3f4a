"""The queries of this subpackage and, where SQL can express them, the SQL that they equal."""

from __future__ import annotations

from dramaturg.llm import decontamination, exact_dedup, hard_negatives, language_id, line_dedup, merkle, mixing, near_dedup, packing, quality, sharding, token_counts, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality": quality.op2_quality,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": language_id.op9_language_id,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_packing": packing.op13_packing,
}

SQL = {
    "op3_near_dedup": near_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_warc": warc.SQL,
    "op6_decontamination": decontamination.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
