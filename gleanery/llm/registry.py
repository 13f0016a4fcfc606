"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from gleanery.llm import chat, decontam, embedding_dedup, fingerprint, langid, lexical_search, license_scan, mixing, prefix_trie, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_warc": warc.op5_warc,
    "op6_language_id": langid.op6_language_id,
    "op7_chat_format": chat.op7_chat_format,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_simhash_dedup": simhash.op10_simhash_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_fingerprint": fingerprint.op13_fingerprint,
}

SQL = {
    "op2_license_scan": license_scan.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_embedding_dedup": embedding_dedup.SQL,
    "op5_warc": warc.SQL,
    "op7_chat_format": chat.SQL,
    "op9_mix_sources": mixing.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
