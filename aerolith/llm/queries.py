"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from aerolith.llm import chat, context_tree, decontaminate, encoding, filter_audit, language, mixing, near_duplicates, neighbours, quality, spelling, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_near_duplicates": near_duplicates.op2_near_duplicates,
    "op3_sentencepiece": encoding.op3_sentencepiece,
    "op4_quality": quality.op4_quality,
    "op5_language": language.op5_language,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_chat_format": chat.op7_chat_format,
    "op8_lm_score": context_tree.op8_lm_score,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_mix": mixing.op11_mix,
    "op12_spelling": spelling.op12_spelling,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {"op7_chat_format": chat.ORACLE, "op11_mix": mixing.ORACLE, "op12_spelling": spelling.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
