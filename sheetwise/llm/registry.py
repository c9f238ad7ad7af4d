"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import lm_score, mixing, piece_codec, quality_cnn, quality_rules, simhash, token_counts, token_files, url_filter, vector_search

QUERIES = {
    "op1_url_filters": url_filter.query,
    "op2_mixing": mixing.query,
    "op3_sentencepiece": piece_codec.query,
    "op4_token_counts": token_counts.query,
    "op5_token_files": token_files.query,
    "op6_lm_scoring": lm_score.query,
    "op7_nearest_neighbours": vector_search.query,
    "op8_simhash": simhash.query,
    "op9_quality_classifier": quality_cnn.query,
    "op10_quality_rules": quality_rules.query,
}
ORACLES = {"op1_url_filters": url_filter.SQL, "op2_mixing": mixing.SQL, "op10_quality_rules": quality_rules.SQL}
