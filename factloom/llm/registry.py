"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from factloom.llm import boilerplate, bpe, chat, jaccard, langid, media, packing, pii, prefixtrie, sharding, topk, vectorcodes, warc

QUERIES = {
    "op1_content_defined_chunks": media.op1_content_defined_chunks,
    "op2_rendezvous_sharding": sharding.op2_rendezvous_sharding,
    "op3_budgeted_windows": chat.op3_budgeted_windows,
    "op4_bpe_encode_decode": bpe.op4_bpe_encode_decode,
    "op5_binary_packing": packing.op5_binary_packing,
    "op6_pivot_top_k": topk.op6_pivot_top_k,
    "op7_language_mixture": langid.op7_language_mixture,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_weak_supervision_pii": pii.op9_weak_supervision_pii,
    "op10_warc_round_trip": warc.op10_warc_round_trip,
    "op11_prefix_trie": prefixtrie.op11_prefix_trie,
    "op12_block_rules": boilerplate.op12_block_rules,
    "op13_equal_average_codes": vectorcodes.op13_equal_average_codes,
}

SQL = {
    "op2_rendezvous_sharding": sharding.OP2_SQL,
    "op3_budgeted_windows": chat.OP3_SQL,
    "op6_pivot_top_k": topk.OP6_SQL,
    "op8_ngram_jaccard_join": jaccard.OP8_SQL,
    "op10_warc_round_trip": warc.OP10_SQL,
    "op11_prefix_trie": prefixtrie.OP11_SQL,
    "op13_equal_average_codes": vectorcodes.OP13_SQL,
}
