"""A training-corpus pipeline of five stages, each one operator of fieldloom.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. Each stage's result is written and read again as
the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontamination, line_dedup, near_dedup, packing, quality
from fieldloom.llm.common import dropped, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines, and documents that the rules reject."""
    return quality.cleaned(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a repeated line in one document only."""
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, as operator 5 links them (four words, similarity 0.8)."""
    return near_dedup.cleaned(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: Token ids can't be computed in SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = staged(docs)
            if before:  # the stage that read it is written
                dropped(spark, before)
            before = path
    return docs
