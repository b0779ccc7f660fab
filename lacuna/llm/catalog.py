"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lacuna.llm import conversation, language_id, line_dedup, mixing, ngram_join, packing, quality_model, quality_rules, spelling, substring_dedup, topk, url_filter, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language_id.op9_language_id,
    "op10_topk": topk.op10_topk,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_conversation_repair": conversation.op12_conversation_repair,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_ngram_jaccard": ngram_join.OP4_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
}
