"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from siltstone.llm import avi, decontaminate, fingerprints, html_text, jaccard, langid, pieces, prefix_trie, repair, simple8b, substrings, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_media_columns": avi.op3_media_columns,
        "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_language_id": langid.op6_language_id,
        "op7_sentence_pieces": pieces.op7_sentence_pieces,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_token_id_files": simple8b.op9_token_id_files,
        "op10_url_filters": url_filter.op10_url_filters,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_document_fingerprints": fingerprints.op13_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substrings.SQL, "op4_ngram_jaccard": jaccard.SQL, "op10_url_filters": url_filter.SQL, "op11_conversation_repair": repair.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_document_fingerprints": fingerprints.SQL}
