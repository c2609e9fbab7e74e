"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from skyledger.llm import divergence, exact_dedup, licenses, line_dedup, mixing, ngram_join, packing, pii, quality, url_filter, vector_codes, vector_search, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_warc": warc.query,
    "op3_line_dedup": line_dedup.query,
    "op4_url_filters": url_filter.query,
    "op5_pii": pii.query,
    "op6_mixing": mixing.query,
    "op7_quality_rules": quality.query,
    "op8_best_fit_packing": packing.query,
    "op9_ngram_join": ngram_join.query,
    "op10_license_scans": licenses.query,
    "op11_vector_codes": vector_codes.query,
    "op12_source_divergence": divergence.query,
    "op13_nearest_neighbours": vector_search.query,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_warc": warc.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_ngram_join": ngram_join.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_nearest_neighbours": vector_search.SQL,
}
