"""The corpus queries and their SQL."""

from __future__ import annotations

from tidemark.llm import html_text, language, lines, matroska, minhash, mixing, pieces, quality, repeats, token_shards

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": language.op5_language_id,
    "op6_substring_dedup": repeats.op6_substring_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_token_shards": token_shards.op8_token_shards,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_matroska": matroska.op10_matroska,
}
ORACLE_SQL = {
    "op1_minhash_dedup": minhash.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op6_substring_dedup": repeats.OP6_SQL,
}
