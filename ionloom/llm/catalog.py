"""The registered queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from ionloom.llm import chat, exact_dedup, fingerprint, near_dup, packing, pieces, quality, ranked, repair, sharding, substrings, token_counts, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_quality": quality.op7_quality,
    "op8_minhash_near_dedup": near_dup.op8_minhash_near_dedup,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_ranked_search": ranked.op13_ranked_search,
}

ORACLES = {
    "op6_chat_formatting": chat.OP6_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op8_minhash_near_dedup": near_dup.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
    "op13_ranked_search": ranked.OP13_SQL,
}
