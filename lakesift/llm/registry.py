"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lakesift.llm import decontaminate, line_dedup, lm, mixing, ngram_join, pieces, prefix_trie, quality, resample, token_counts, topk, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_token_counts": token_counts.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_toxicity": toxicity.query,
    "op5_sentencepiece": pieces.query,
    "op6_lm_scoring": lm.query,
    "op7_quality_rules": quality.query,
    "op8_exact_top_k": topk.query,
    "op9_mix_sources": mixing.query,
    "op10_warc": warc.query,
    "op11_decontaminate": decontaminate.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_resample": resample.query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op3_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op8_exact_top_k": topk.ORACLE_SQL,
    "op9_mix_sources": mixing.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_decontaminate": decontaminate.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_resample": resample.ORACLE_SQL,
}
