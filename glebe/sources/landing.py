"""Landed CSV files: manifest of dialects, then one read per group of files with the same dialect."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.functions import text
from glebe.operators.conform import conform_quotes, conform_sales, concat, fill_quote_year, fill_sale_period
from glebe.schemas import WORK_LOG_FIELDS
from glebe.sources.csv_records import csv_records, file_lines, parsed_records
from glebe.sources.tables import staged


@dataclass(frozen=True)
class Dialect:
    """How the separator of a source is told: from the header or the whole file, and on a tie."""

    by_header: bool
    semicolon_when_none: bool

    def separator(self, semicolons: Column, commas: Column) -> Column:
        wins = semicolons >= commas
        if not self.semicolon_when_none:
            wins = wins & (semicolons > 0)
        return F.when(wins, ";").otherwise(",")


QUOTE_DIALECT = Dialect(by_header=True, semicolon_when_none=True)
SALE_DIALECT = Dialect(by_header=False, semicolon_when_none=False)


def _bytes_of(c: Column, char: str) -> Column:
    """How often an ASCII character occurs, counted in bytes so that any encoding will do."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(char), F.lit("")))


def csv_manifest(spark: SparkSession, path: str, dialect: Dialect, file_year: Callable[[Column], Column]) -> DataFrame:
    """One row per CSV file: path, name, format, year, quarter, separator, encoding, header line, and ``coupe``: whether
    a quoted cell may hold a line break (a line has an odd number of quotes).

    Files are scanned as lines, so a large file is shared by many tasks and only counts are gathered.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
    )
    # Within a file's first block the ids rise line by line.
    head = F.col("_block") == 0
    files = lines.groupBy("path", "name").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.sum(_bytes_of(F.col("value"), ";")).alias("_semicolons"),
        F.sum(_bytes_of(F.col("value"), ",")).alias("_commas"),
        F.bool_or(_bytes_of(F.col("value"), '"') % 2 == 1).alias("coupe"),
        F.min(F.when(head, F.struct("_line", "value"))).alias("_first"),
    )
    encoding = F.when(F.col("_utf8"), "UTF-8").otherwise("ISO-8859-1")
    first = F.col("_first.value").cast("binary")
    header = F.when(F.col("_utf8"), first.cast("string")).otherwise(F.decode(first, "ISO-8859-1"))
    counted = [_bytes_of(F.col("_first.value"), c) if dialect.by_header else F.col(n) for c, n in ((";", "_semicolons"), (",", "_commas"))]
    return files.select(
        "path", "name", F.lit("CSV").alias("format"), file_year(F.col("name")).alias("annee"),
        text.quarter_in_text(F.col("name")).alias("trimestre"),
        dialect.separator(*counted).alias("separateur"), encoding.alias("encodage"), header.alias("entete"), "coupe",
    )


def file_manifest(spark: SparkSession, path: str, file_year: Callable[[Column], Column]) -> DataFrame:
    """One row per landed file of any format, from its name alone (contents are not read)."""
    listed = spark.read.format("binaryFile").load(path).select("path")
    name = F.substring_index("path", "/", -1)
    return listed.select(
        "path", name.alias("name"), F.upper(F.substring_index(name, ".", -1)).alias("format"),
        file_year(name).alias("annee"), text.quarter_in_text(name).alias("trimestre"))


def quote_manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv_manifest(spark, path, QUOTE_DIALECT, text.quote_file_year)


def sale_manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv_manifest(spark, path, SALE_DIALECT, text.year_in_text)


def header_names(header: str, separator: str) -> list[str]:
    """Column names of a header line, made unique by a number where they repeat."""
    return unique_names(next(csv.reader([header], delimiter=separator), []))


def unique_names(cells: list[str]) -> list[str]:
    names, seen = [], {}
    for name in cells:
        name = name.lstrip("\ufeff").strip()
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}")
    return names


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def dialect_groups(manifest: DataFrame) -> dict[tuple[str, str, str, bool], list[str]]:
    """(separator, encoding, header, broken lines) -> files: one row per group comes to the driver, with the paths
    that the scan will list there anyway."""
    keys = ("separateur", "encodage", "entete", "coupe")
    groups = manifest.groupBy(*keys).agg(F.collect_list("path").alias("paths")).collect()
    return {tuple(g[k] for k in keys): sorted(map(unquote, g.paths)) for g in groups}


def read_csv_files(spark: SparkSession, manifest: DataFrame, conform: Callable[..., DataFrame]) -> DataFrame:
    """All files of a manifest in the target schema, plus ``_file`` and ``_name``.

    All cells are read as text; ragged lines are cut or filled with nulls. Files are grouped by dialect
    and header, so there are as many reads as distinct headers, not as files. All files are split, also those whose
    quoted cells may hold line breaks; such a break is read as a line feed.
    """
    frames = []
    for (separator, encoding, header, broken), paths in sorted(dialect_groups(manifest).items()):
        schema = text_schema(header_names(header, separator))
        if broken:
            # Put together once: later steps read the rows more than once.
            whole, _ = staged(csv_records(file_lines(spark, paths, encoding), separator), "csv-records")
            raw = parsed_records(whole, schema.toDDL(), separator)
        else:
            raw = (
                spark.read.schema(schema)
                .option("header", True).option("sep", separator).option("encoding", encoding)
                .option("mode", "PERMISSIVE").option("escape", '"').csv(paths)
                .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"))
            )
        frames.append(conform(raw, keep=("_file", "_name")))
    return concat(frames) if frames else no_rows(spark, conform)


def no_rows(spark: SparkSession, conform: Callable[..., DataFrame]) -> DataFrame:
    """The target schema with ``_file`` and ``_name``, and no rows."""
    return conform(spark.createDataFrame([], text_schema(["annee", "_file", "_name"])), keep=("_file", "_name"))


def read_quotes(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Market quotes of the listed files, with the year filled per file."""
    rows = read_csv_files(spark, manifest, conform_quotes)
    dated = rows.withColumn("_file_year", text.quote_file_year(F.col("_name")))
    return fill_quote_year(dated).drop("_file", "_name")


def read_sales(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Land sales of the listed files; year and quarter from the file name, else from the date."""
    rows = read_csv_files(spark, manifest, conform_sales)
    name = F.col("_name")
    return fill_sale_period(rows, text.year_in_text(name), text.quarter_in_text(name)).drop("_file", "_name")


def read_work_log(spark: SparkSession, path: str) -> DataFrame:
    """Work-hour CSV as text columns."""
    return spark.read.schema(text_schema(list(WORK_LOG_FIELDS))).option("header", True).csv(path)
