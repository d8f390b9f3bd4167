"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from corpusloom.llm import (
    q01_url, q02_decontamination, q03_ann, q04_chat, q05_lm, q06_language, q07_packing, q08_suffix, q09_minhash, q10_sharding,
    q11_hard_negatives, q12_filter_audit, q13_top_k,
)

QUERIES = {
    "op1_url_filters": q01_url.op1_url_filters,
    "op2_decontamination": q02_decontamination.op2_decontamination,
    "op3_nearest_neighbours": q03_ann.op3_nearest_neighbours,
    "op4_chat_formatting": q04_chat.op4_chat_formatting,
    "op5_lm_scoring": q05_lm.op5_lm_scoring,
    "op6_language_id": q06_language.op6_language_id,
    "op7_packing": q07_packing.op7_packing,
    "op8_suffix_array_dedup": q08_suffix.op8_suffix_array_dedup,
    "op9_minhash_near_dedup": q09_minhash.op9_minhash_near_dedup,
    "op10_sharding": q10_sharding.op10_sharding,
    "op11_hard_negative_mining": q11_hard_negatives.op11_hard_negative_mining,
    "op12_filter_interaction_audit": q12_filter_audit.op12_filter_interaction_audit,
    "op13_exact_top_k": q13_top_k.op13_exact_top_k,
}
SQL = {
    "op1_url_filters": q01_url.SQL,
    "op2_decontamination": q02_decontamination.SQL,
    "op3_nearest_neighbours": q03_ann.SQL,
    "op8_suffix_array_dedup": q08_suffix.SQL,
    "op11_hard_negative_mining": q11_hard_negatives.SQL,
    "op12_filter_interaction_audit": q12_filter_audit.SQL,
    "op13_exact_top_k": q13_top_k.SQL,
}
