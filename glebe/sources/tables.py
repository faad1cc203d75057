"""Parquet tables: probe, read, replace years, replace all, append, keep-latest update."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.operators.latest import upsert
from glebe.session import drop_scratch, scratch_path

# Conditions Spark reports for a path without readable files.
_NO_FILES = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table below a path or glob. Without files: empty with the given schema, else None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in _NO_FILES:
            raise
    return None if schema is None else spark.createDataFrame([], schema)


def table_exists(spark: SparkSession, path: str) -> bool:
    return read_table(spark, path) is not None


def with_missing_columns(df: DataFrame, wanted: T.StructType) -> tuple[DataFrame, list[str]]:
    """Add absent columns as typed nulls; also tells which were absent."""
    absent = [f for f in wanted if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}), [f.name for f in absent]


def write_years(df: DataFrame, path: str, year: str = "annee", order: list[str] | None = None) -> None:
    """Replace the years present in ``df``, leave the others.

    Rows are brought together by year and large years are split again at runtime, so neither one task per
    year nor one file per task and year results. ``order`` sorts within each task for tight row-group
    statistics. The input must not read from ``path``; see ``upsert_table`` for that.
    """
    laid_out = df.hint("rebalance", F.col(year))
    if order:
        laid_out = laid_out.sortWithinPartitions(year, *order)
    (laid_out.write.mode("overwrite").partitionBy(year)
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path))


def write_all(df: DataFrame, path: str) -> None:
    """Replace the whole table. The input must not read from ``path``."""
    df.hint("rebalance").write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written once to the work folder, for steps that read them several times; and their path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def replace_unless_empty(df: DataFrame, path: str, year: str | None = None, order: list[str] | None = None) -> bool:
    """Replace the table, or with ``year`` the years present; nothing fetched leaves it as it is. Tells if it wrote."""
    rows, scratch = staged(df, "load")
    some = not rows.isEmpty()
    if some and year:
        write_years(rows, path, year, order)
    elif some:
        write_all(rows.sortWithinPartitions(*order) if order else rows, path)
    drop_scratch(df.sparkSession, scratch)
    return some


def last_days(spark: SparkSession, path: str, keys: list[str], date: str = "date") -> DataFrame | None:
    """Last known ``date`` per key of a stored table, None without a table.

    Read from the table itself, so it can never tell of rows that are not there; only the key and date columns are
    scanned, and tasks pass on one row a key.
    """
    table = read_table(spark, path)
    return None if table is None else table.groupBy(*keys).agg(F.max(date).alias(date))


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], date: str = "date",
                 year: str = "annee") -> None:
    """Merge new rows into a table partitioned by year, newest row per key; keys that the table repeats are merged too.

    The batch is worked out once. Only the touched years are read and rewritten. The merged years are first written to
    the shared work folder: the table is never read and overwritten by one job, and a lost executor is recovered from
    files that stay.
    """
    batch, batch_path = staged(new.withColumn(year, F.year(date)), "batch")
    if not batch.isEmpty():
        old = read_table(spark, path)
        if old is not None:
            old = old.join(batch.select(year).distinct(), year, "left_semi")
        merged, merged_path = staged(upsert(old, batch, keys), "upsert")
        write_years(merged, path, year, [k for k in keys if k != year])
        drop_scratch(spark, merged_path)
    drop_scratch(spark, batch_path)
