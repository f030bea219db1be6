"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_cascade, decontaminate, divergence, fill_middle, filter_audit, katz, minmax, packing, prefix_counts, repeats, simhash, toxicity, warc
from .storage import bounded_batches


Query = Callable[[SparkSession, str], DataFrame]


def _bounded(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    every = {
        "op1_spaced_seeds": decontaminate.op1_spaced_seeds,
        "op2_distribution_divergence": divergence.op2_distribution_divergence,
        "op3_generalised_pigeonhole": simhash.op3_generalised_pigeonhole,
        "op4_warc_revisits": warc.op4_warc_revisits,
        "op5_katz_backoff": katz.op5_katz_backoff,
        "op6_bloom_cascade": bloom_cascade.op6_bloom_cascade,
        "op7_pattern_grammar": toxicity.op7_pattern_grammar,
        "op8_prefix_counts": prefix_counts.op8_prefix_counts,
        "op9_phrase_automata": repeats.op9_phrase_automata,
        "op10_configuration_packing": packing.op10_configuration_packing,
        "op11_marker_injection": fill_middle.op11_marker_injection,
        "op12_filter_interactions": filter_audit.op12_filter_interactions,
        "op13_minmax_hashing": minmax.op13_minmax_hashing,
    }
    return {name: _bounded(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_spaced_seeds": decontaminate.ORACLE_SQL,
        "op2_distribution_divergence": divergence.ORACLE_SQL,
        "op4_warc_revisits": warc.ORACLE_SQL,
        "op6_bloom_cascade": bloom_cascade.ORACLE_SQL,
        "op9_phrase_automata": repeats.ORACLE_SQL,
        "op11_marker_injection": fill_middle.ORACLE_SQL,
        "op12_filter_interactions": filter_audit.ORACLE_SQL,
        "op13_minmax_hashing": minmax.ORACLE_SQL,
    }
