"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, context_tree, embedding_dedup, fingerprints, license_scan, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, spelling_variants


def queries():
    return {
        "op1_license_scan": license_scan.query, "op2_quality_classifier": quality_classifier.query, "op3_mixing": mixing.query,
        "op4_chat_formatting": chat.query, "op5_embedding_dedup": embedding_dedup.query,
        "op6_ngram_jaccard_join": ngram_join.query, "op7_quality_rules": quality_rules.query, "op8_lm_scoring": context_tree.query,
        "op9_line_dedup": line_dedup.query, "op10_packing": packing.query,
        "op11_periodic_runs": periodic_runs.query, "op12_spelling_variants": spelling_variants.query, "op13_fingerprints": fingerprints.query,
    }


def oracle_sql():
    return {"op1_license_scan": license_scan.sql(), "op3_mixing": mixing.sql(), "op4_chat_formatting": chat.sql(), "op7_quality_rules": quality_rules.sql(), "op9_line_dedup": line_dedup.sql()}
