"""The queries of this subpackage by name, and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

from storyloom.llm import binary_ids, decontamination, fingerprints, language, merkle, packing, prefix_trie, sharding, simhash, sum_of_squares, token_counts, toxicity, urls

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_simhash": simhash.op2_simhash,
    "op3_language": language.op3_language,
    "op4_urls": urls.op4_urls,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_sharding": sharding.op6_sharding,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_binary_ids": binary_ids.op9_binary_ids,
    "op10_packing": packing.op10_packing,
    "op11_online_packing": sum_of_squares.op11_online_packing,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op4_urls": urls.OP4_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
