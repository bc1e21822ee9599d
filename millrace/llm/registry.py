"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_extract, license_scan, line_dedup, mixing, quality, resampling, secrets, simhash, url_filter, vector_codes

QUERIES = {
    "op1_licenses": license_scan.op1_licenses,
    "op2_quality": quality.op2_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_html": html_extract.op6_html,
    "op7_mixing": mixing.op7_mixing,
    "op8_secrets": secrets.op8_secrets,
    "op9_bpe": bpe.op9_bpe,
    "op10_urls": url_filter.op10_urls,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_resample": resampling.op12_resample,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

ORACLE_SQL = {
    "op2_quality": quality.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op8_secrets": secrets.SQL,
    "op10_urls": url_filter.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_resample": resampling.SQL,
    "op13_decontaminate": decontaminate.SQL,
}
