"""The registered queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from palimpsest.llm import chat_format, decontaminate, embedding_dup, html_text, language_id, license_scan, near_dup, packing, quality, resampling, suffix_dedup, token_align, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_near_dedup": near_dup.op2_near_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_packing": packing.op5_packing,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_html_text": html_text.op7_html_text,
    "op8_language_id": language_id.op8_language_id,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_embedding_dedup": embedding_dup.op10_embedding_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_token_alignment": token_align.op13_token_alignment,
}
SQL = {
    "op2_near_dedup": near_dup.SQL,
    "op3_url_filter": url_filter.SQL,
    "op9_chat_format": chat_format.SQL,
    "op10_embedding_dedup": embedding_dup.SQL,
    "op11_resampling": resampling.SQL,
    "op12_suffix_dedup": suffix_dedup.SQL,
}
