"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, chroma, chunking, classifier, jaccard, packing, pieces, quality, repair, resample, secrets, simhash, wrapper

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_chroma_alignment": chroma.op2_chroma_alignment,
    "op3_simhash_vptree": simhash.op3_simhash_vptree,
    "op4_html_extraction": wrapper.op4_html_extraction,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_packing": packing.op6_packing,
    "op7_substring_dedup": chunking.op7_substring_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_nbest_pieces": pieces.op10_nbest_pieces,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_ngram_jaccard": jaccard.op13_ngram_jaccard,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_importance_resampling": resample.OP12_SQL,
    "op13_ngram_jaccard": jaccard.OP13_SQL,
}
