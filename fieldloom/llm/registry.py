"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from fieldloom.llm import centroids, fingerprints, language_mixture, line_dedup, near_dedup, packing, quality, search, secrets, sentencepieces, token_files, url_filters, windows

QUERIES = {
    "op1_language_mixture": language_mixture.op1_language_mixture,
    "op2_sentencepiece_scan": sentencepieces.op2_sentencepiece_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_order_minhash": near_dedup.op5_order_minhash,
    "op6_bitplane_tokens": token_files.op6_bitplane_tokens,
    "op7_syncmer_fingerprints": fingerprints.op7_syncmer_fingerprints,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_secret_ledger": secrets.op9_secret_ledger,
    "op10_config_lp_packing": packing.op10_config_lp_packing,
    "op11_simplex_clusters": centroids.op11_simplex_clusters,
    "op12_best_fit_decreasing": windows.op12_best_fit_decreasing,
    "op13_bit_sliced_search": search.op13_bit_sliced_search,
}
ORACLE_SQL = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op8_url_filters": url_filters.ORACLE_SQL,
    "op11_simplex_clusters": centroids.ORACLE_SQL,
    "op13_bit_sliced_search": search.ORACLE_SQL,
}
