"""Operator 7: exact length histogram with suffix sums.

Documents are counted by encoded length; each task sends one row for each
length it saw. Running sums over the lengths, first over ranges of them and
then inside a range, answer totals, quantiles and truncated totals for
every context limit, also for limits between two lengths.

Defined results: null and empty texts have length 0; repeated rows count
as often as they occur; other columns are ignored; an empty table gives an
empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, staged, table
from .tokens import TEXT_BYTES, encoder, tokenizer_path

#: Lengths of one range of the running sums.
RANGE = 4096


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = encoder(path).lengths, Counter()
        for batch in pieces(batches, "raw", TEXT_BYTES):
            seen.update(lengths(batch.column("raw")).tolist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    raw = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    return raw.mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def answers(counts: DataFrame) -> DataFrame:
    """For each length taken as the context limit: documents and tokens up to it, from it, beyond it, and the total after truncation."""
    rows = counts.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / RANGE).alias("_range"), (F.col("n_tokens") * F.col("n_docs")).alias("_tokens"))
    ranges = rows.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    ranges = ranges.select("_range", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")], *[F.sum(c).over(all_).alias(f"{c}_all") for c in ("_d", "_t")])
    own = Window.partitionBy("_range").orderBy(F.desc("n_tokens"))
    out = rows.join(ranges, "_range").select(
        "n_tokens", "n_docs", "_d_all", "_t_all",
        (F.sum("n_docs").over(own) + F.col("_d_later")).alias("docs_from"),
        (F.sum("_tokens").over(own) + F.col("_t_later")).alias("tokens_from"),
        F.col("_tokens"),
    )
    beyond_docs, beyond_tokens = F.col("docs_from") - F.col("n_docs"), F.col("tokens_from") - F.col("_tokens")
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", beyond_docs.alias("docs_beyond"), beyond_tokens.alias("tokens_beyond"),
        (F.col("_d_all") - beyond_docs).alias("docs_to"), (F.col("_t_all") - beyond_tokens).alias("tokens_to"),
        (F.col("_t_all") - beyond_tokens + F.col("n_tokens") * beyond_docs).alias("truncated_total"),
        ((F.col("_d_all") - beyond_docs) / F.col("_d_all")).alias("share_to"),
    )


def truncated_total(found: DataFrame, limit: int) -> int:
    """Tokens that are left when every document is cut to `limit`, for any limit."""
    row = found.filter(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("tokens_to", "docs_beyond"), "n_tokens").alias("s")).first()["s"]
    if row is None:  # all documents are longer
        return limit * (found.agg(F.max("docs_from")).first()[0] or 0)
    return row["tokens_to"] + limit * row["docs_beyond"]


def quantile(found: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share q of the documents doesn't exceed."""
    reached: Column = F.col("share_to") >= q
    return found.filter(reached).agg(F.min("n_tokens")).first()[0]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = staged(histogram(table(spark, sf_dir, "documents").select("text")))  # read twice, by ranges and by lengths
    return answers(counts)
