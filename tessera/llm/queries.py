"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, license_scan, line_dedup, mixing, periodic_runs, prefix_trie, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_quality_rules": quality_rules.query,
        "op3_token_counts": token_counts.query,
        "op4_line_dedup": line_dedup.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_decontamination": decontamination.query,
        "op8_warc": warc.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_mixing": mixing.query,
        "op11_periodic_runs": periodic_runs.query,
        "op12_license_scan": license_scan.query,
        "op13_prefix_trie": prefix_trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.SQL, "op4_line_dedup": line_dedup.SQL, "op5_jaccard_join": jaccard_join.SQL, "op6_suffix_dedup": suffix_dedup.SQL,
        "op7_decontamination": decontamination.SQL, "op8_warc": warc.SQL, "op10_mixing": mixing.SQL,
        "op11_periodic_runs": periodic_runs.SQL, "op13_prefix_trie": prefix_trie.SQL,
    }
