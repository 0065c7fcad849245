"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stallbook.llm import (
    chat,
    cover_tree,
    divergence,
    hard_negatives,
    html_text,
    language,
    mixing,
    near_duplicates,
    packing,
    pseudo_likelihood,
    quality,
    sharding,
    tokens,
)

QUERIES = {
    "op1_vector_packing": packing.op1_vector_packing,
    "op2_boosted_quality": quality.op2_boosted_quality,
    "op3_sampled_splitters": sharding.op3_sampled_splitters,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_pseudo_likelihood": pseudo_likelihood.op5_pseudo_likelihood,
    "op6_cover_tree_topk": cover_tree.op6_cover_tree_topk,
    "op7_partenum_join": near_duplicates.op7_partenum_join,
    "op8_html_main_text": html_text.op8_html_main_text,
    "op9_language_id": language.op9_language_id,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_segment_negatives": hard_negatives.op11_segment_negatives,
    "op12_segment_divergence": divergence.op12_segment_divergence,
    "op13_prefix_chat": chat.op13_prefix_chat,
}

SQL = {
    "op6_cover_tree_topk": cover_tree.SQL,
    "op11_segment_negatives": hard_negatives.SQL,
    "op12_segment_divergence": divergence.SQL,
    "op13_prefix_chat": chat.SQL,
}
