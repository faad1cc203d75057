"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glebe.llm.common import byte_pair_encoding, in_batches, stage, text_or_empty

VOCABULARY = "byte_bpe_50k.tiktoken"
_BUCKET = 256


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The number of token ids of each text, one row each; a null text has none."""

    def lengths(batches):
        import pyarrow as pa

        encoder = byte_pair_encoding(vocabulary)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(text)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["length"])

    return in_batches(docs.select(text_or_empty(text_col).alias("text")), lengths, "length bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """Documents of each length."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(bars: DataFrame) -> DataFrame:
    """Per length that occurs, read as a context limit L, what the whole corpus holds.

    ``docs_longer`` and ``tokens_longer``: documents above L and their tokens. ``docs_within`` and
    ``tokens_within``: the rest. ``truncated_tokens``: tokens left if each document is cut to L. ``quantile``: share
    of documents not above L. Sums run within buckets of lengths, then over the few buckets, so that no task holds
    the whole histogram. An empty corpus has no rows.
    """
    bars = stage(bars, "lengths").withColumn("bucket", F.floor(F.col("length") / _BUCKET))
    bars = bars.withColumn("tokens", F.col("length") * F.col("n_docs"))
    above = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sums = bars.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = sums.select("bucket", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
                          F.coalesce(F.sum("all_tokens").over(later), F.lit(0)).alias("tokens_after"),
                          F.sum("docs").over(whole).alias("docs"), F.sum("all_tokens").over(whole).alias("all_tokens"))
    longer = F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("docs_after")
    tokens_longer = F.coalesce(F.sum("tokens").over(above), F.lit(0)) + F.col("tokens_after")
    out = bars.join(buckets, "bucket").select("length", "n_docs", "docs", "all_tokens",
                                              longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"))
    return out.select(
        "length", "n_docs", "docs_longer", "tokens_longer",
        (F.col("docs") - F.col("docs_longer")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("docs") - F.col("docs_longer")) / F.col("docs")).alias("quantile"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left under any context limit, also between the lengths that occur: (limit, truncated_tokens)."""
    cases = [F.struct(F.lit(limit).cast("bigint").alias("limit"),
                      F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")).alias("truncated_tokens"))
             for limit in limits]
    return sums.agg(F.array(*cases).alias("cases")).select(F.inline("cases"))


def quantile_length(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("length").alias("length"))
