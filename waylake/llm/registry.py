"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from waylake.llm import filter_audit, langid, line_dedup, mpeg_audio, packing, pieces, pii, quality, rollup, secrets, simhash, token_files, vector_codes

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_files": token_files.op2_token_files,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": rollup.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_mpeg_audio": mpeg_audio.op10_mpeg_audio,
    "op11_secrets": secrets.op11_secrets,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "rollup_words": rollup.rollup_words,
}

ORACLES: dict[str, str] = {
    "op12_vector_codes": vector_codes.CODES_SQL,
    "op13_filter_audit": filter_audit.AUDIT_SQL,
    "rollup_words": rollup.WORDS_SQL,
}
