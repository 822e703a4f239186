"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tallyspark.llm import bpe, chat, exact_dedup, filter_audit, mixing, packing, pii, ppm, quality, resampling, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_lm_scoring": ppm.op2_lm_scoring,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_pii": pii.op8_pii,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_packing": packing.op12_packing,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {"op1_mix_sources": mixing.SQL, "op4_exact_dedup": exact_dedup.SQL, "op7_chat_formatting": chat.SQL, "op9_quality_rules": quality.SQL, "op13_filter_audit": filter_audit.SQL}
