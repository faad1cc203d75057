"""CSV records whose quoted cells hold line breaks, cut in parallel from the lines of split files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glebe.session import scratch_path


def ends_open(line: Column, separator: str) -> Column:
    """Whether a line that begins a record ends within a quoted cell.

    A quote opens a cell only as its first character; within it, two quotes are one character, and after the closing
    quote everything up to the separator is plain. The expression drops one whole cell after the other, so its time is
    linear and its depth constant for any length of line.
    """
    single = F.replace(line, F.lit('""'), F.lit(""))
    whole_cell = rf'\G(?:"[^"]*+"[^{separator}]*+|[^"{separator}][^{separator}]*+)?+{separator}'
    return F.regexp_replace(single, whole_cell, "").rlike(r'\A"[^"]*+\z')


def file_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """Lines of files: ``path``, ``name``, ``block`` (where its split starts), ``line`` (rising within a block), ``value``.

    Any of the usual line ends will do, and large files are shared by many tasks.
    """
    raw = F.col("value").cast("binary")
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        (raw.cast("string") if encoding == "UTF-8" else F.decode(raw, encoding)).alias("value"))


def _with_turns(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds what all earlier pieces of a key do to the state (0 outside, 1 within a quoted cell): ``known`` is null or
    overrides the state at the start, then ``turns`` is added to it.

    A piece has ``fixed`` (the state after it, if the one before does not matter) and ``flips`` (1 if it turns the state).
    """
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = pieces.withColumn("turns", F.coalesce(F.sum("flips").over(earlier), F.lit(0)))
    return turned.withColumn("known", F.last(F.col("fixed") + F.col("turns"), ignorenulls=True).over(earlier))


def csv_records(lines: DataFrame, separator: str) -> DataFrame:
    """Records of the lines of files: ``path``, ``name``, ``value`` (its lines, joined by a line feed) and ``first``
    (whether it is the first of its file).

    Each line is a map of the state before it to the state after it. The maps are composed within each block, then over
    the blocks of a file (one row a block), which tells the state at every line and where its record began, in whatever
    block that is. The lines and their maps are staged once: splits of a later scan could differ. No task holds more than
    a block or a record. A quote that opens a cell and is never closed makes the rest of its file one record, as in any
    reader; the line end at the end of a file is no part of it. Empty files have no record; repeated lines are records of
    their own.
    """
    spark = lines.sparkSession
    outside, within = (ends_open(c, separator).cast("int") for c in (F.col("value"), F.concat(F.lit('"'), "value")))
    mapped = lines.withColumns({"outside": outside, "within": within}).select(
        "path", "name", "block", "line", "value",
        F.when(F.col("outside") == F.col("within"), F.col("outside")).alias("fixed"),
        (F.col("outside") > F.col("within")).cast("int").alias("flips"))
    staged = scratch_path(spark, "csv-lines")
    _with_turns(mapped, ["path", "block"], "line").write.parquet(staged)
    mapped = spark.read.parquet(staged)

    def state(start: Column) -> Column:
        return (F.coalesce("known", start) + F.col("turns")) % 2

    def last_start(start: int) -> Column:
        return F.max(F.when(state(F.lit(start)) == 0, F.col("line")))

    last_fixed = F.max_by(F.col("fixed") + F.col("turns"), F.when(F.col("fixed").isNotNull(), F.col("line")))
    blocks = mapped.groupBy("path", "block").agg(
        last_fixed.alias("last_fixed"), F.sum("flips").alias("all_flips"), F.min("line").alias("head"),
        last_start(0).alias("start_0"), last_start(1).alias("start_1"),
    ).withColumns({
        "fixed": (F.col("last_fixed") + F.col("all_flips")) % 2,
        "flips": F.when(F.col("last_fixed").isNull(), F.col("all_flips") % 2).otherwise(0)})
    blocks = _with_turns(blocks, ["path"], "block").withColumn("entered", state(F.lit(0)))
    own_start = F.when(F.col("entered") == 0, F.col("start_0")).otherwise(F.col("start_1"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(own_start.isNotNull(), F.struct("block", own_start.alias("line")))
    blocks = blocks.select("path", "block", "entered", "head", F.last(begun, ignorenulls=True).over(earlier).alias("carried"))

    so_far = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = mapped.join(blocks, ["path", "block"])
    begins = F.when(state(F.col("entered")) == 0, F.struct("block", "line"))
    placed = placed.withColumn("record", F.coalesce(F.last(begins, ignorenulls=True).over(so_far), F.col("carried")))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    return placed.groupBy("path", "name", "record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"),
        F.bool_or((F.col("block") == 0) & (F.col("line") == F.col("head"))).alias("first"),
    ).drop("record")


def parsed_records(records: DataFrame, schema: str, separator: str) -> DataFrame:
    """Cells of the records after the first of each file, with ``_file`` and ``_name``; blank records are left out."""
    cells = F.from_csv("value", schema, {"sep": separator, "escape": '"', "mode": "PERMISSIVE"})
    kept = records.filter(~F.col("first") & (F.trim("value") != ""))
    return kept.select(cells.alias("cells"), F.col("path").alias("_file"), F.col("name").alias("_name")).select(
        "cells.*", "_file", "_name")
