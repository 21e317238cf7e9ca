"""Queries of this package: name -> callable(spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontam, langid, licenses, orc_tokens, packing, periodic, phrases, pieces, quality_fm, rules, simhash, suffix

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality_fm": quality_fm.op2_quality_fm,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_packing": packing.op4_packing,
    "op5_language_spans": langid.op5_language_spans,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_orc_tokens": orc_tokens.op7_orc_tokens,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_suffix_dedup": suffix.op9_suffix_dedup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_phrases": phrases.op13_phrases,
}

# The others go beyond SQL (models, hash functions, token ids, byte strings): tests compare them with brute force.
ORACLE_SQL = {
    "op3_quality_rules": rules.OP3_SQL,
    "op6_decontamination": decontam.OP6_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
