"""The subpackage's queries, and SQL for those that it can express."""

from __future__ import annotations

from . import decontaminate, html_extract, lexical_search, line_dedup, mixing, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, token_counts, topk, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup,
        quality_rules.op2_quality_rules,
        token_counts.op3_token_counts,
        html_extract.op4_html_extraction,
        quality_classifier.op5_quality_classifier,
        near_dedup.op6_minhash_near_dedup,
        toxicity.op7_toxicity,
        mixing.op8_mix_sources,
        topk.op9_exact_top_k,
        packing.op10_best_fit_packing,
        periodic_runs.op11_periodic_runs,
        decontaminate.op12_benchmark_decontamination,
        lexical_search.op13_ranked_search,
    )
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op12_benchmark_decontamination": decontaminate.ORACLE,
    "op13_ranked_search": lexical_search.ORACLE,
}
