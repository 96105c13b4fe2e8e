"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftset.llm import boilerplate, decontam, jaccard, licences, lm, mixing, quality, suffixes, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_lm_scoring": lm.op3_lm_scoring,
        "op4_suffix_dedup": suffixes.op4_suffix_dedup,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_license_scan": licences.op7_license_scan,
        "op8_warc_roundtrip": warc.op8_warc_roundtrip,
        "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
        "op10_line_dedup": boilerplate.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": jaccard.SQL, "op6_source_mixing": mixing.SQL, "op8_warc_roundtrip": warc.SQL, "op10_line_dedup": boilerplate.SQL}
