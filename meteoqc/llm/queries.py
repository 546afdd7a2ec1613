"""Registered corpus queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meteoqc.llm import (
    decontaminate,
    hard_negatives,
    multi_index,
    ngram_join,
    packing,
    periodic_runs,
    personal_data,
    quality,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
    window_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_multi_index": multi_index.op6_multi_index,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_window_dedup": window_dedup.op8_window_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_packing": packing.op10_packing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_personal_data": personal_data.op13_personal_data,
}
ORACLES: dict[str, str] = {"op12_hard_negatives": hard_negatives.ORACLE}
