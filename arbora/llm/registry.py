"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from arbora.llm import decontaminate, exact_dedup, html_extract, licences, mixing, ngram_join, quality, suffix_dedup, token_counts, url_filter


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_mixing": mixing.op2_mixing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_jaccard_join": ngram_join.op5_jaccard_join,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_licence_scan": licences.op8_licence_scan,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql():
    found: dict[str, str] = {}
    for module in (quality, mixing, exact_dedup, html_extract, ngram_join, suffix_dedup, token_counts, licences, url_filter, decontaminate):
        found.update(module.SQL)
    return found
