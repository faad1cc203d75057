"""Keep-latest merge and the refresh plan that feeds it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.functions.dates import backfill_start
from glebe.operators.conform import concat

WEATHER_KEYS = ["latitude", "longitude", "date"]


def keep_latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One whole row per key: the one with the greatest ``order``, nulls in it included.

    Equal orders are settled by the row's own values, so a rerun gives the same table. A partial
    aggregate does the work, so a key with many versions shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(order.alias("_order"), *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(
        *(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def upsert(existing: DataFrame | None, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Old and new rows, the new row winning per key; columns missing on one side become null.

    One row per key remains, also of keys that the old rows repeat.
    """
    keys = keys or WEATHER_KEYS
    newest = keep_latest(new.withColumn("_new", F.lit(1)), keys, F.col("_new")).drop("_new")
    if existing is None:
        return newest
    both = concat([existing.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))], relaxed=True)
    return keep_latest(both, keys, F.col("_new")).drop("_new")


def refresh_plan(wanted: DataFrame, existing: DataFrame | None, end: dt.date, backfill_years: int = 5,
                 lookback_days: int = 30, force_full: bool = False,
                 keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """Per wanted point: first and last day to fetch and the mode.

    "full" starts at the backfill year; "incremental" re-reads the lookback before the last known day,
    but never goes before the backfill start. Points that are up to date have ``a_jour`` true.
    """
    keys = keys or ["latitude", "longitude"]
    first = backfill_start(F.lit(end), backfill_years)
    if existing is None or force_full:
        plan = wanted.withColumn("_last", F.lit(None).cast("date"))
    else:
        plan = wanted.join(existing.groupBy(*keys).agg(F.max(date).alias("_last")), keys, "left")
    start = F.when(F.col("_last").isNull(), first).otherwise(F.greatest(first, F.date_sub("_last", lookback_days)))
    mode = F.when(F.col("_last").isNull(), "full").otherwise("incremental")
    return (
        plan.withColumn("debut", start).withColumn("fin", F.lit(end)).withColumn("mode", mode)
        .withColumn("a_jour", F.col("debut") > F.col("fin")).drop("_last")
    )
