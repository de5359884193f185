"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from threadloom.llm import bpe, chat_format, exact_dedup, html_extract, jaccard_join, language_id, license_scan, packing, prefix_trie, quality_classifier, quality_rules, spelling_variants, token_store

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_store": token_store.op4_token_store,
    "op5_chat_formatting": chat_format.op5_chat_formatting,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_packing": packing.op10_packing,
    "op11_quality_classifier": quality_classifier.op11_quality_classifier,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_chat_formatting": chat_format.OP5_SQL,
    "op7_quality_rules": quality_rules.sql_of(),
    "op12_spelling_variants": spelling_variants.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
