"""The registered queries of the training-text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from issuelens.llm import (
    ann, chat, clustering, decontaminate, html_extract, katz, langid, minhash, mixing, quality, substring_dedup, toxicity,
    variants,
)

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_minhash_dedup": minhash.query,
    "op3_toxicity": toxicity.query,
    "op4_decontaminate": decontaminate.query,
    "op5_katz_scores": katz.query,
    "op6_html_extract": html_extract.query,
    "op7_language_id": langid.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_nearest": ann.query,
    "op10_mix_sources": mixing.query,
    "op11_quality_rules": quality.query,
    "op12_spelling_variants": variants.query,
    "op13_centroid_clusters": clustering.query,
}

ORACLE = {
    "op1_chat_format": chat.ORACLE,
    "op2_minhash_dedup": minhash.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op11_quality_rules": quality.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_centroid_clusters": clustering.ORACLE,
}
