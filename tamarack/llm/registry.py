"""Queries of the training-data operations."""

from __future__ import annotations

from . import collocations, decontaminate, fingerprints, lexical_search, licenses, mixing, ngram_join, oracle, pii, secrets, substring_dedup, suffix_dedup, token_counts, toxicity


def queries():
    return {
        "op1_mix": mixing.op1_mix,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_pii": pii.op5_pii,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_licenses": licenses.op8_licenses,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_secrets": secrets.op10_secrets,
        "op11_substring_dedup": substring_dedup.op11_substring_dedup,
        "op12_collocations": collocations.op12_collocations,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql():
    return {
        "op1_mix": mixing.mix_sql("documents", "doc_id, source"),
        "op4_ngram_join": oracle.ngram_join_sql(),
        "op8_licenses": oracle.licenses_sql(),
        "op9_decontaminate": oracle.decontaminate_sql(),
        "op10_secrets": oracle.secrets_sql(),
        "op11_substring_dedup": oracle.substring_dedup_sql(),
        "op12_collocations": oracle.collocations_sql(),
        "op13_lexical_search": oracle.lexical_search_sql(),
    }
