"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from tidelog.llm import ann, chat, manifest, mixing, ngrams, pieces, pii, quality, repeats, tokens, trie, urls, warc

QUERIES = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_warc": warc.op2_warc,
    "op3_ngram_join": ngrams.op3_ngram_join,
    "op4_quality": quality.op4_quality,
    "op5_ann": ann.op5_ann,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_chat": chat.op10_chat,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_token_counts": tokens.op13_token_counts,
}
ORACLES = {
    "op1_url_filters": urls.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_ngram_join": ngrams.OP3_SQL,
    "op4_quality": quality.OP4_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
}
