"""The queries of this subpackage and the SQL that expresses them, by name."""

from __future__ import annotations

from termloom.llm import bpe, html_text, near_dedup, packing, quality, sharding, suffix_dedup, topk, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_topk": topk.op3_topk,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_bpe": bpe.op6_bpe,
    "op7_packing": packing.op7_packing,
    "op8_sharding": sharding.op8_sharding,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extraction": html_text.op10_html_extraction,
}
ORACLE_SQL = {
    "op3_topk": topk.ORACLE,
    "op2_url_filters": url_filter.ORACLE,
}
