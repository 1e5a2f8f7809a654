"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, embedding_dedup, exact_dedup, language_id, language_model, license_scan, mixing, simhash_dedup

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_mixing": mixing.op2_mixing,
    "op3_bpe": bpe.op3_bpe,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_language_model": language_model.op5_language_model,
    "op6_simhash": simhash_dedup.op6_simhash,
    "op7_token_counts": bpe.op7_token_counts,
    "op8_language_id": language_id.op8_language_id,
    "op9_chat": chat.op9_chat,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
