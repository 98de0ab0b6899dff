"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import bpe, exact_dedup, fingerprint, language, near_dedup, packing, pii, quality, substring_dedup, token_count

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_language": language.op2_language,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_token_count": token_count.op10_token_count,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
}
