"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from turnweave.llm import decontaminate, jaccard, language, pieces, pii, quality, suffix_dedup, token_counts, token_files, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_sentencepiece": pieces.query,
    "op3_token_counts": token_counts.query,
    "op4_decontamination": decontaminate.query,
    "op5_url_filters": urls.query,
    "op6_token_files": token_files.query,
    "op7_language_id": language.query,
    "op8_pii": pii.query,
    "op9_quality_rules": quality.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
SQL = {
    "op1_ngram_jaccard_join": jaccard.SQL,
    "op5_url_filters": urls.SQL,
    "op9_quality_rules": quality.SQL,
}
