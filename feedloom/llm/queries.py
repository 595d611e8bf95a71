"""Queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    centroid_clustering,
    decontam,
    exact_dedup,
    html_extraction,
    line_quality,
    mixing,
    pii,
    simhash,
    spelling_variants,
    substring_dedup,
    token_counts,
    toxicity,
    warc_archive,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc_archive": warc_archive.op4_warc_archive,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_benchmark_decontamination": decontam.op10_benchmark_decontamination,
    "op11_line_quality": line_quality.op11_line_quality,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op4_warc_archive": warc_archive.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_line_quality": line_quality.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_centroid_clustering": centroid_clustering.ORACLE,
}
