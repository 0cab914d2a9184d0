"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from driftlens.llm import (
    decontamination, exact_dedup, html_text, jaccard_join, license_scan, mixing, periodic_runs, prefix_trie, quality, quality_rules, secret_scan,
    substring_dedup, token_counts,
)

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_html_text": html_text.op2_html_text,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_suffix_dedup": substring_dedup.op8_suffix_dedup,
    "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op9_ngram_jaccard": jaccard_join.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
}
