"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import (
    chat, html_text, importance, jaccard, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece_ops, sharding, sql, suffix_dedup, topk, whitening,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece_ops.op1_sentencepiece,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_topk_search": topk.op4_topk_search,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_html_text": html_text.op10_html_text,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLES = {
    "op2_mixing": sql.OP2,
    "op4_topk_search": sql.OP4,
    "op5_chat_formatting": sql.OP5,
    "op8_sharding": sql.OP8,
    "op9_quality_rules": sql.OP9,
    "op12_line_dedup": sql.OP12,
    "op13_importance_resampling": sql.OP13,
}
