"""The queries of this subpackage, and SQL for those that SQL can express. The pipeline of five of them is corpus_pipeline.py at the top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup, lm_scoring, near_dedup, packing, pii, quality, secrets, token_counts, toxicity
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_pii": pii.op9_pii,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}
