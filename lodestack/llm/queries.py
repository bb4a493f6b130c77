"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestack.llm import chat, html, langid, media, mixing, ngram, packing, quality, simhash, tokencount

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_query,
    "op2_media_webp": media.op2_query,
    "op3_language_id": langid.op3_query,
    "op4_quality_rules": quality.op4_query,
    "op5_lm_scoring": ngram.op5_query,
    "op6_html_extraction": html.op6_query,
    "op7_mixture_packing": packing.op7_query,
    "op8_source_mixing": mixing.op8_query,
    "op9_token_counts": tokencount.op9_query,
    "op10_chat_formatting": chat.op10_query,
}

#: Only what SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
}
