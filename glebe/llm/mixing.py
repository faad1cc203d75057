"""Sources mixed to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.llm.common import stage, whole_row

#: Without given weights, a source weighs as its number of documents to this power: below 1 evens sources out.
EVENNESS = 0.5
_SPREAD = 64


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the seed and the keys' text; the same on every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_count(rate: Column, draw: Column) -> Column:
    """The count whose Poisson distribution function first exceeds the draw, for any rate.

    The sum starts where the mass below is nothing (twelve deviations below the rate), with the logarithm of the
    probability there, so that no rate underflows.
    """
    lowest = F.floor(rate - 12 * F.sqrt(rate) - 12).cast("double")
    first = F.when(lowest >= 50, lowest).otherwise(0.0)
    x = first + 1
    # The logarithm of the factorial by Stirling's series, good to 15 digits from 50 on.
    factorial = (x - 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    p = F.exp(F.when(first > 0, first * F.log(rate) - factorial).otherwise(0.0) - rate)
    start = F.struct(p.alias("p"), p.alias("upto"), first.alias("n"))
    steps = F.transform(F.sequence(F.lit(1), F.ceil(rate - first + 12 * F.sqrt(rate) + 12).cast("int")), lambda i: first + i)
    drawn = F.aggregate(steps, start, lambda acc, k: F.when(acc.upto > draw, acc).otherwise(
        F.struct((acc.p * rate / k).alias("p"), (acc.upto + acc.p * rate / k).alias("upto"), k.alias("n"))))
    return drawn.n.cast("int")


def repetition_rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None,
                     total: float | None = None) -> DataFrame:
    """Mean repetitions per source: its share of the weights, times the wanted total, over its documents.

    ``total`` defaults to the number of documents. A source without a weight gets none; null is a source.
    """
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(EVENNESS))
    else:
        pairs = [F.lit(x) for name, value in weights.items() for x in (name, float(value))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("mix_source", F.lit(""))),
                            F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    all_weight = sizes.agg(F.sum("weight")).scalar()
    wanted = F.lit(float(total)) if total is not None else sizes.agg(F.sum("n").cast("double")).scalar()
    return sizes.select("mix_source", F.when(all_weight > 0, F.col("weight") / all_weight * wanted / F.col("n"))
                        .otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        weights: Mapping[str, float] | None = None, total: float | None = None, seed: int = 17,
        copy_col: str | None = "copy") -> DataFrame:
    """Every document as often as its hash-seeded Poisson draw says, in one global random order.

    Returns the columns of the input and the copy's number from 0 in ``copy_col``, which replaces an input column of
    that name; None leaves it out. The draw hangs on the seed and the id alone, so a
    repeated row draws alike and all documents with a null id share a draw. Texts are not read. Each copy goes to a
    partition and a place in it by hash; a document repeated in many rows is spread, not sent to one partition, by the
    rows' places in their files. So ``docs`` should be a stored table, which a task that runs again reads alike.
    """
    row = "mix_row"
    # Staged, so that Spark knows its size and sends a small one to all tasks instead of shuffling texts by source.
    rates = stage(repetition_rates(docs, source_col, weights, total), "rates")
    keyed = docs.select(whole_row(docs.drop(copy_col) if copy_col else docs).alias(row), F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_from"),
                        F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD)).alias("mix_salt"))
    counted = keyed.join(rates, F.col("mix_from").eqNullSafe(F.col("mix_source")))
    counted = counted.withColumn("n", poisson_count(F.col("rate"), uniform(seed, F.col("mix_id"))))
    copies = counted.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    order = uniform(seed + 1, F.col("mix_id"), F.col("copy"))
    spread = copies.withColumn("mix_order", order).repartition("mix_order", "mix_salt")
    numbers = [F.col("copy").alias(copy_col)] if copy_col else []
    return spread.sortWithinPartitions("mix_order").select(f"{row}.*", *numbers)
