"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from courtside.llm import bpe, compaction, conversation_trie, html_extract, lexical_search, licenses, mixing, ngram_join, quality, secret_scan, token_counts, topk, warc

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_compacted_shards": compaction.op2_compacted_shards,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_html_text": html_extract.op9_html_text,
    "op10_warc": warc.op10_warc,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op2_compacted_shards": compaction.ORACLE,
    "op4_quality_rules": quality.oracle(),
    "op6_exact_top_k": topk.ORACLE,
    "op7_license_scan": licenses.oracle(),
    "op9_html_text": html_extract.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
