"""ZIP archives of CSV files."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glebe.functions import text
from glebe.operators.conform import concat, conform_quotes, conform_sales, fill_quote_year, fill_sale_period
from glebe.session import scratch_path
from glebe.sources.landing import QUOTE_DIALECT, SALE_DIALECT, Dialect, no_rows, unique_names

_RECORDS = "path string, member string, entete array<string>, cellules array<string>, error string"


# Fixed value: the mark that begins each member of a ZIP file.
MEMBER_MARK = "PK\x03\x04"

_ENTRIES = ("path string, member string, place bigint, method int, flags int, crc bigint, packed bigint, size bigint, "
            "error string")


def _csv_worker(dialect: Dialect):
    """(output of a member, failure): batches of ``_RECORDS`` for tasks; both are sent to tasks as they are."""
    by_header, on_tie = dialect.by_header, dialect.semicolon_when_none
    names = [column.split()[0] for column in _RECORDS.split(", ")]

    def failure(source, member, message):
        import pyarrow as pa

        cells = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([source]), pa.array([member], pa.string()), pa.nulls(1, cells), pa.nulls(1, cells),
             pa.array([str(message)[:200]])], names)

    def separator_and_encoding(stream):
        """Reads the member to its end, so a damaged one fails here."""
        import codecs

        valid, semicolons, commas, header_done = True, 0, 0, False
        decoder = codecs.getincrementaldecoder("utf-8")()
        while chunk := stream.read(1 << 20):
            if valid:
                try:
                    decoder.decode(chunk)
                except UnicodeDecodeError:
                    valid = False
            counted = chunk
            if by_header:
                counted = b"" if header_done else chunk.split(b"\n", 1)[0]
                header_done = header_done or b"\n" in chunk
            semicolons, commas = semicolons + counted.count(b";"), commas + counted.count(b",")
        wins = semicolons >= commas and (on_tie or semicolons > 0)
        return ";" if wins else ",", "utf-8-sig" if valid else "latin-1"

    def records(opened, source, member):
        """``opened()`` gives the member's bytes as a stream, from the start each time."""
        import csv
        import io

        import pyarrow as pa

        def output(rows):
            n, cells = len(rows), pa.list_(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([source] * n), pa.array([member] * n, pa.string()), pa.array([header] * n, cells),
                 pa.array([[c or None for c in row] for row in rows], cells), pa.nulls(n, pa.string())], names)

        csv.field_size_limit(1 << 30)
        with opened() as stream:
            separator, encoding = separator_and_encoding(stream)
        with io.TextIOWrapper(opened(), encoding=encoding, newline="") as lines:
            rows = csv.reader(lines, delimiter=separator)
            header = next(rows, [])
            held = []
            for row in rows:
                if row:
                    held.append(row)
                if len(held) == 10_000:
                    yield output(held)
                    held = []
            if held:
                yield output(held)

    def guarded(opened, source, member):
        import csv
        import zipfile
        import zlib

        try:
            yield from records(opened, source, member)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, UnicodeError,
                csv.Error, ValueError) as problem:
            yield failure(source, member, problem)

    return guarded, failure


def unpack(files: DataFrame, dialect: Dialect) -> DataFrame:
    """Records of all CSV members of archives held in a table (``path``, ``content``): the cells, with the header of their
    member.

    Quoted cells may hold line breaks; an empty cell is null. An archive is unpacked by one task, member by member and
    in batches; archives in files are better read by ``unpack_files``. A broken archive, one without CSV members, and
    each member that cannot be read as a whole give one row with ``error`` and nothing else; the other members stay.
    """
    guarded, failure = _csv_worker(dialect)

    def unzip(batches):
        import functools
        import io
        import zipfile

        for batch in batches:
            for source, content in zip(batch.column("path"), batch.column("content")):
                source = source.as_py()
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                    members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
                except (zipfile.BadZipFile, OSError, NotImplementedError, ValueError):
                    yield failure(source, None, "not a ZIP archive")
                    continue
                if not members:
                    yield failure(source, None, "no CSV member")
                for member in members:
                    yield from guarded(functools.partial(archive.open, member), source, member)

    return files.select("path", "content").mapInArrow(unzip, _RECORDS)


def _entries(tails: DataFrame) -> DataFrame:
    """Members that the directories of archives list, from their ends (``path``, ``tail``, ``begins``, where it starts).

    ``place`` is the position of the member's mark. An end without a directory gives one row with ``error``.
    """
    columns = [column.split()[0] for column in _ENTRIES.split(", ")]

    def listed(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    members = zipfile.ZipFile(io.BytesIO(row["tail"])).infolist()
                except (zipfile.BadZipFile, OSError, NotImplementedError, ValueError):
                    rows.append((row["path"], *[None] * 7, "not a ZIP archive"))
                    continue
                if not any(m.filename.lower().endswith(".csv") for m in members):
                    rows.append((row["path"], *[None] * 7, "no CSV member"))
                # The directory's positions count from the start of what was opened, however far back that lies.
                rows += [(row["path"], m.filename, row["begins"] + m.header_offset, m.compress_type, m.flag_bits, m.CRC,
                          m.compress_size, m.file_size, None) for m in members]
            types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
            fields = [pa.field(c, types[t]) for c, t in (column.split() for column in _ENTRIES.split(", "))]
            yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], pa.schema(fields))

    return tails.select("path", "tail", "begins").mapInArrow(listed, _ENTRIES)


def _directory_bytes(ends: DataFrame) -> DataFrame:
    """How many bytes before the end of a file its directory begins: ``path``, ``needed`` (0 if there is no end mark).

    Fixed layouts: the end record has the directory's size at byte 12; where that is all ones, the large record has it at
    byte 40 and counts itself (56 bytes) and its locator (20 bytes) in between.
    """
    def measured(batches):
        import struct

        import pyarrow as pa

        def needed(tail):
            end = tail.rfind(b"PK\x05\x06")
            if end < 0 or len(tail) < end + 22:
                return 0
            size = struct.unpack_from("<L", tail, end + 12)[0]
            large = tail.rfind(b"PK\x06\x06", 0, end)
            if size == 0xFFFFFFFF and 0 <= large <= end - 76:
                size = struct.unpack_from("<Q", tail, large + 40)[0] + 76
            return len(tail) - end + size

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([needed(t.as_buffer().to_pybytes()) for t in batch.column("data")], pa.int64())],
                ["path", "needed"])

    return ends.select("path", "data").mapInArrow(measured, "path string, needed bigint")


def unpack_files(spark: SparkSession, paths: str | list[str], dialect: Dialect) -> DataFrame:
    """Records of all CSV members of archive files, as ``unpack`` gives them: members of one archive run in many tasks.

    Archives are split at the marks of their members, as text files are at line ends, so neither an archive nor its
    directory has to fit in a row; a member does (2 GB as packed). The directory, at the end of the file, tells which
    marks begin a member; other pieces belong to the member before them. A member that the directory places where no
    mark is gives an error row. The pieces are staged once. Scans leave out empty files.
    """
    raw = spark.read.option("lineSep", MEMBER_MARK).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("data"),
        (F.octet_length("value") + len(MEMBER_MARK)).cast("bigint").alias("bytes"))
    staged = scratch_path(spark, "archive-pieces")
    raw.write.parquet(staged)
    pieces, at = spark.read.parquet(staged), ["path", "block", "line"]

    def so_far(keys: list[str], order: str) -> Column:
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("bytes").over(earlier), F.lit(0))

    blocks = pieces.groupBy("path", "block").agg(F.sum("bytes").alias("bytes"))
    blocks = blocks.withColumn("before", so_far(["path"], "block")).select("path", "block", "before")
    placed = pieces.select(*at, "bytes").withColumn("within", so_far(["path", "block"], "line"))
    placed = placed.join(blocks, ["path", "block"])
    placed = placed.select(*at, (F.col("before") + F.col("within")).alias("start"), "bytes")

    # The mark that ends a piece is no part of it; the last one has none.
    files = placed.groupBy("path").agg((F.max(F.col("start") + F.col("bytes")) - len(MEMBER_MARK)).alias("total"),
                                       F.max(F.struct("start", "block", "line")).alias("last"))
    ends = pieces.join(files.select("path", "last.block", "last.line"), at)
    wanted = files.join(_directory_bytes(ends), "path").select(
        "path", F.least(F.col("last.start"), F.greatest(F.col("total") - F.col("needed"), F.lit(0))).alias("from"))
    near = placed.join(wanted, "path").filter(F.col("start") + F.col("bytes") > F.col("from"))
    parts = F.array_sort(F.collect_list(F.struct("start", "data")))
    joined = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0))["data"],
                         lambda text, part: F.concat(text, F.lit(MEMBER_MARK).cast("binary"), part["data"]))
    tails = near.join(pieces.drop("bytes"), at).groupBy("path").agg(joined.alias("tail"), F.min("start").alias("begins"))
    listing = scratch_path(spark, "archive-members")
    _entries(tails).write.parquet(listing)
    entries = spark.read.parquet(listing)

    csv_members = entries.filter(F.lower("member").endswith(".csv"))
    starts = entries.filter("place is not null").select("path", "place", (F.col("place") + len(MEMBER_MARK)).alias("start"))
    begun = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = placed.join(starts.distinct(), ["path", "start"], "left").withColumn(
        "place", F.last("place", ignorenulls=True).over(begun))
    wholes = owned.join(csv_members.select("path", "place").distinct(), ["path", "place"], "left_semi")
    packed = pieces.drop("bytes").join(wholes.select(*at, "start", "place"), at).groupBy("path", "place").agg(
        joined.alias("data"), F.min("start").alias("start"))
    members = csv_members.join(packed, ["path", "place"], "left").withColumn(
        "error", F.when(F.coalesce(F.col("start") != F.col("place") + len(MEMBER_MARK), F.lit(True)), "no member at its place"))
    failed = entries.filter("error is not null")
    every = members.select(*entries.columns, "data").unionByName(failed, allowMissingColumns=True)
    guarded, failure = _csv_worker(dialect)

    def unzip(batches):
        import functools
        import io
        import struct
        import zipfile

        def opened(data, row):
            if row["flags"] & 1:
                raise RuntimeError("encrypted")
            names, extra = struct.unpack_from("<HH", data, 22)
            info = zipfile.ZipInfo(row["member"])
            info.compress_type, info.flag_bits, info.CRC = row["method"], row["flags"], row["crc"]
            info.compress_size, info.file_size = row["packed"], row["size"]
            stream = io.BytesIO(data)
            stream.seek(26 + names + extra)
            return zipfile.ZipExtFile(stream, "r", info)

        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if row["error"] is not None:
                    yield failure(row["path"], row["member"], row["error"])
                else:
                    data = batch.column("data")[i].as_buffer()
                    yield from guarded(functools.partial(opened, data, row), row["path"], row["member"])

    return every.mapInArrow(unzip, _RECORDS)


def archive_rows(files: DataFrame, dialect: Dialect, conform: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows in the target schema with ``_file`` and ``_name``, error rows) of archives in a table (``path``, ``content``)."""
    return _conformed(unpack(files, dialect), conform)


def _conformed(records: DataFrame, conform: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows and error rows of unpacked records, which are worked out once, into the work folder; only the distinct
    headers come to the driver."""
    spark = records.sparkSession
    path = scratch_path(spark, "unpacked")
    records.write.parquet(path)
    unpacked = spark.read.parquet(path)
    errors = unpacked.filter(F.col("error").isNotNull()).select("path", "member", "error")
    headers = sorted(tuple(r.entete) for r in unpacked.filter(F.col("entete").isNotNull()).select("entete").distinct().collect())
    frames = []
    for header in headers:
        own = unpacked.filter(F.col("entete") == F.array(*(F.lit(h) for h in header)))
        raw = own.select(
            *(F.get("cellules", F.lit(i)).alias(n) for i, n in enumerate(unique_names(header))),
            F.concat_ws("!", "path", "member").alias("_file"),
            F.substring_index("path", "/", -1).alias("_name"))
        frames.append(conform(raw, keep=("_file", "_name")))
    return (concat(frames) if frames else no_rows(spark, conform)), errors


def read_archives(spark: SparkSession, path: str | list[str], dialect: Dialect,
                  conform: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of the archives below a path, or of the listed ones."""
    paths = [unquote(p) for p in path] if isinstance(path, list) else path
    if not paths:
        return no_rows(spark, conform), spark.createDataFrame([], "path string, member string, error string")
    return _conformed(unpack_files(spark, paths, dialect), conform)


def read_quote_archives(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Market quotes from archives; the year is filled per member, at last from the archive name."""
    rows, errors = read_archives(spark, path, QUOTE_DIALECT, conform_quotes)
    dated = rows.withColumn("_file_year", text.quote_file_year(F.col("_name")))
    return fill_quote_year(dated).drop("_file", "_name"), errors


def read_sale_archives(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Land sales from archives; year and quarter from the archive name, else from the date."""
    rows, errors = read_archives(spark, path, SALE_DIALECT, conform_sales)
    name = F.col("_name")
    return fill_sale_period(rows, text.year_in_text(name), text.quarter_in_text(name)).drop("_file", "_name"), errors
