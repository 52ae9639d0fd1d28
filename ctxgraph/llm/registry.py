"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, chat, decontam, html, neardup, pii, quality, tokencount, toxicity

QUERIES = {
    "op1_cross_polytope_ann": ann.op1_cross_polytope_ann,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_chat_format": chat.op5_chat_format,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_simhash_near_duplicates": neardup.op7_simhash_near_duplicates,
    "op8_token_counts": tokencount.op8_token_counts,
    "op9_pii": pii.op9_pii,
    "op10_html_text": html.op10_html_text,
}
ORACLES: dict[str, str] = {
    "op4_decontamination": decontam.ORACLE,
    "op5_chat_format": chat.ORACLE,
}
