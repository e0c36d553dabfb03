"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from quillmesh.llm import centroids, chat_format, embedding_dedup, html_text, mixing, near_dup, packing, quality_rules, quantiles, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op5_html_text": html_text.op5_html_text,
    "op8_chat_format": chat_format.op8_chat_format,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op1_ngram_jaccard_join": near_dup.op1_ngram_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op4_source_mix": mixing.op4_source_mix,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_quantile_summaries": quantiles.op12_quantile_summaries,
    "op13_token_files": token_files.op13_token_files,
    "chat_tool_calls": chat_format.chat_tool_calls,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": near_dup.OP1_SQL,
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_centroid_clusters": centroids.OP11_SQL,
    "chat_tool_calls": chat_format.CALLS_SQL,
}
