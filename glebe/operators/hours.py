"""Work-hour log: entries from texts, timer pairs, typed table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glebe.functions.dates import date_parts, duration_hours, hours_between, relative_date
from glebe.functions.numbers import rounded
from glebe.functions.text import lenient_double

# Events of one worker that one task pairs, up to the hour that passes it.
TIMER_BLOCK = 100_000


def typed_hours(log: DataFrame) -> DataFrame:
    """Text log to typed rows with date parts; bad dates and numbers become null."""
    day = F.try_to_date("date", "yyyy-MM-dd")
    typed = log.withColumns({"date": day, "duree_h": lenient_double(F.col("duree_h"))})
    return typed.withColumns(date_parts(F.col("date")))


def entries_from_text(requests: DataFrame, ref_date: dt.date) -> DataFrame:
    """Manual entries (id, poste, duree, jour, notes) to log rows; ``error`` names what was not understood.

    An empty day means the reference date.
    """
    ref = F.lit(ref_date)
    hours = duration_hours(F.col("duree"))
    no_day = F.coalesce(F.trim("jour"), F.lit("")) == ""
    day = F.when(no_day, ref).otherwise(relative_date(F.col("jour"), ref))
    error = F.when(hours.isNull(), "duree").when(day.isNull(), "jour")
    return requests.select(
        "id", day.alias("date"), F.lit("").alias("debut"), F.lit("").alias("fin"),
        rounded(hours, 2).alias("duree_h"), "poste", F.coalesce("notes", F.lit("")).alias("notes"),
        F.lit("manuel").alias("source"), error.alias("error"),
    )


def hours_from_timer(events: DataFrame, worker: str = "worker", at: str = "ts", kind: str = "kind",
                     task: str = "poste", seconds: bool = False) -> DataFrame:
    """Start/stop events paired per worker: task, day, start, stop, hours (and whole ``secondes`` if asked).

    A start counts when the worker's next event is a stop; other starts and stray stops are dropped, and so are events
    without a time. Equal times are ordered by kind and task.

    Each worker's hours are put together, in order, to blocks of some ``TIMER_BLOCK`` events, so that a badge shared by many
    is spread over tasks and only an hour of it must fit into one. A pair across the end of a block is kept by also
    looking at the first event after it.
    """
    cut = events.select(worker, F.col(at).alias("_at"), F.col(kind).alias("_kind"), F.col(task).alias("_task"),
                        F.date_trunc("hour", F.col(at)).alias("_hour")).filter(F.col("_at").isNotNull())
    counted = cut.groupBy(worker, "_hour").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_at", "_kind", "_task")).alias("_head"))
    earlier = Window.partitionBy(worker).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.withColumn("_block", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / TIMER_BLOCK))
    # First event of each block, copied to the block before it.
    heads = blocks.groupBy(worker, "_block").agg(F.min("_head").alias("_head"))
    previous = F.lag("_block").over(Window.partitionBy(worker).orderBy("_block"))
    heads = heads.withColumn("_block", previous).filter(F.col("_block").isNotNull()).select(
        worker, F.col("_head._at").alias("_at"), F.col("_head._kind").alias("_kind"),
        F.col("_head._task").alias("_task"), "_block").withColumn("_copy", F.lit(True))
    found = blocks.select(F.col(worker).alias("_worker"), F.col("_hour").alias("_of"), "_block")
    rows = cut.join(found, F.col(worker).eqNullSafe(F.col("_worker")) & (F.col("_hour") == F.col("_of"))).select(
        worker, "_at", "_kind", "_task", "_block").withColumn("_copy", F.lit(False)).unionByName(heads)
    order = Window.partitionBy(worker, "_block").orderBy("_at", "_kind", "_task")
    paired = rows.withColumn("_next", F.lead(F.struct("_at", "_kind")).over(order))
    kept = paired.filter(~F.col("_copy") & (F.col("_kind") == "start") & (F.col("_next._kind") == "stop"))
    exact = [F.timestamp_diff("SECOND", F.col("_at"), F.col("_next._at")).alias("secondes")] if seconds else []
    return kept.select(
        worker, F.col("_task").alias("poste"), F.col("_at").cast("date").alias("date"),
        F.date_format("_at", "HH:mm").alias("debut"), F.date_format("_next._at", "HH:mm").alias("fin"),
        hours_between(F.col("_at"), F.col("_next._at")).alias("duree_h"),
        F.lit("timer").alias("source"), *exact,
    )


def last_entries(log: DataFrame, n: int = 15, order: str = "date", key: str = "id") -> DataFrame:
    """The n newest entries, newest first."""
    return log.orderBy(F.col(order).desc_nulls_last(), F.col(key).desc()).limit(n)
