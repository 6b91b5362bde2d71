"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, fingerprint, jaccard_join, license_scan, negatives, packing, phrase_automata, pii, spelling, suffix_dedup, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": suffix_dedup.query,
    "op2_url_filters": url_filter.query,
    "op3_pii": pii.query,
    "op4_bpe_round_trip": bpe.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_fingerprints": fingerprint.query,
    "op7_toxicity": toxicity.query,
    "op8_benchmark_decontamination": decontaminate.query,
    "op9_substring_dedup": phrase_automata.query,
    "op10_license_scans": license_scan.query,
    "op11_spelling_variants": spelling.query,
    "op12_packing": packing.query,
    "op13_hard_negatives": negatives.query,
}
SQL: dict[str, str] = {"op2_url_filters": url_filter.SQL, "op10_license_scans": license_scan.SQL, "op13_hard_negatives": negatives.SQL}
