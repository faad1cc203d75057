"""Objects of JSON lists, cut in parallel from split files: one large list or page is shared by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glebe.session import scratch_path

_SCALARS = r'\A(?:[\s,]|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s,"{\[])*+'
# Bytes of a chunk, if none of its pieces is longer; and of a row group of chunks, which a scan holds as a whole.
CHUNK_BYTES = 1 << 18
_ROW_GROUP_BYTES = 32 << 20
_QUOTE, _BACKSLASH, _LIST, _OBJECT, _END = b'"\\[{}'
_CHUNKS = ("path string, file_bytes bigint, block bigint, chunk bigint, text binary, bytes bigint, first string, flips int, "
           "climb_0 int, low_0 int, openings_0 map<int,boolean>, climb_1 int, low_1 int, openings_1 map<int,boolean>")
_WHOLE = "path string, json boolean, values array<string>"
_PARTS = "path string, ended_block bigint, ended_chunk bigint, block bigint, chunk bigint, value binary, closes boolean"


def _worker(key: str | None):
    """(chunks, whole, parts): what tasks run over Arrow batches. As closures they need nothing of the library there.

    * ``chunks`` joins pieces that follow one another in a split, and tells what a chunk does to the string state and the
      depth, as it begins outside (0) or within a string (1): the depth gained, the lowest depth at which a brace is
      closed, and for each depth whether the last bracket that led down to it opens the list.
    * ``whole`` gives the records that lie in one chunk, a row a chunk. Scalars before an object are left out up to the
      first string.
    * ``parts`` gives the parts of records that lie in several chunks, each with the chunk where the record before it
      ended, and whether it closes its record.
    """
    def where(rising, values):
        """Places of those rising numbers that are among the values."""
        import numpy as np

        at = np.searchsorted(rising, values)
        at = at[at < len(rising)]
        return at[np.isin(rising[at], values)]

    def brackets_of(text):
        """Brackets of a chunk: place, kind, whether an odd number of quotes stands before, whether it opens a list under
        the key (any list, without one); and the number of quotes. No escape reaches a closing brace, as it ends a piece.
        """
        import re

        import numpy as np

        data = np.frombuffer(text, np.uint8)
        told = np.zeros(256, bool)
        told[list(b'"\\[]{}')] = True
        at = np.flatnonzero(told[data]).astype(np.int32)
        kind = data[at]
        slashes = at[kind == _BACKSLASH]
        if len(slashes):
            begins = np.append(True, slashes[1:] != slashes[:-1] + 1)
            lengths = np.bincount(np.cumsum(begins) - 1)
            escaped = slashes[np.append(begins[1:], True)][lengths % 2 == 1] + 1
            kept = kind != _BACKSLASH
            kept[where(at, escaped)] = False
            kept |= kind == _END
            at, kind = at[kept], kind[kept]
        quote = kind == _QUOTE
        quotes = np.cumsum(quote, dtype=np.int32)
        brackets = np.flatnonzero(~quote)
        places, kinds, odd = at[brackets], kind[brackets], quotes[brackets] & 1 == 1
        marks = kinds == _LIST
        if key is not None:
            marks[:], name = False, b'"%b"' % key.encode()
            if name in text:
                spans = np.array([m.span() for m in re.finditer(re.escape(name) + rb"\s*:\s*\[", text)], np.int64).reshape(-1, 2)
                # An escaped quote begins no key; whether the others begin or end a string is told as for the bracket.
                keys = at[quote]
                keys = keys[where(keys, spans[:, 0])]
                marks[where(places, spans[np.isin(spans[:, 0], keys), 1] - 1)] = True
        return places, kinds, odd, marks, int(quote.sum())

    def levels_of(kinds):
        """Depth after each bracket, against that before the first; and whether it opens."""
        import numpy as np

        opens = (kinds == _LIST) | (kinds == _OBJECT)
        return np.cumsum(np.where(opens, np.int8(1), np.int8(-1)), dtype=np.int32), opens

    def effect(kinds, marks):
        import numpy as np

        if not len(kinds):
            return 0, None, []
        levels, opens = levels_of(kinds)
        closed, led, openings = levels[kinds == _END], levels[opens], []
        if len(led):
            base = int(led.min())
            last = np.full(int(led.max()) - base + 1, -1, np.int8)
            last[led - base] = marks[opens]  # of a depth, the last one stays
            openings = [(base + i, m == 1) for i, m in enumerate(last.tolist()) if m >= 0]
        return int(levels[-1]), int(closed.min()) if len(closed) else None, openings

    def chunks(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        effects = [(f"climb_{i}", f"low_{i}", f"openings_{i}") for i in (0, 1)]
        kinds_of = (pa.int32(), pa.int32(), pa.map_(pa.int32(), pa.bool_()))
        schema = pa.schema([
            ("path", pa.string()), ("file_bytes", pa.int64()), ("block", pa.int64()), ("chunk", pa.int64()), ("text", pa.binary()),
            ("bytes", pa.int64()), ("first", pa.string()), ("flips", pa.int32()),
            *(field for names in effects for field in zip(names, kinds_of, strict=True))])
        for batch in batches:
            if not batch.num_rows:
                continue
            value, path, block = batch.column("value"), batch.column("path"), batch.column("block").to_numpy()
            bounds, data = np.frombuffer(value.buffers()[1], np.int32)[value.offset:][:len(value) + 1], value.buffers()[2]
            other = (block[1:] != block[:-1]) | pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
            runs, rows = [0, *(np.flatnonzero(other) + 1).tolist(), len(block)], []
            for begin, stop in zip(runs[:-1], runs[1:], strict=True):
                while begin < stop:
                    at = int(bounds[begin])
                    end = min(stop, max(begin + 1, int(np.searchsorted(bounds, at + CHUNK_BYTES, "right")) - 1))
                    text = data[at:int(bounds[end])].to_pybytes()
                    _, kinds, odd, marks, quotes = brackets_of(text)
                    first = text[:text.index(b"}")].removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\n\x0b\f\r")[:1]
                    row = {"path": path[begin].as_py(), "file_bytes": batch.column("file_bytes")[begin].as_py(),
                           "block": int(block[begin]), "chunk": batch.column("line")[begin].as_py(), "text": text,
                           "bytes": len(text), "first": first.decode("ascii", "replace"), "flips": quotes % 2}
                    for i, names in enumerate(effects):
                        row |= zip(names, effect(kinds[odd == i], marks[odd == i]), strict=True)
                    rows.append(row)
                    begin = end
            yield pa.RecordBatch.from_pylist(rows, schema)

    def cut(text, own):
        """Stretches of a chunk, the last one open, the others ended by the brace of a record: where the text of each
        starts and stops, whether it stands in the list, whether nothing of it lies before the chunk."""
        import numpy as np

        depth, size = own["depth"], len(text) - own["cut"]
        places, kinds, odd, marks, _ = brackets_of(text)
        outside = odd == (own["state"] == 1)
        places, kinds, marks = places[outside], kinds[outside], marks[outside]
        levels, opens = levels_of(kinds)
        levels = levels + own["entered"]
        ends = places[(kinds == _END) & (levels <= depth) & (places < size)]
        led = opens & (levels == depth) & (depth > 0)
        openings, lists = np.append(-1, places[led]), np.append(own["was_open"] or depth == 0, marks[led])
        starts, stops = np.append(0, ends + 1), np.append(ends + 1, size)
        last = np.searchsorted(openings, stops, "left") - 1
        begun = openings[last] >= starts
        begun[1:] = True
        return np.maximum(starts, openings[last] + 1), stops, lists[last], begun

    def placed_chunks(batches):
        for batch in batches:
            for i, own in enumerate(batch.drop_columns(["text"]).to_pylist()):
                yield own, batch.column("text")[i].as_buffer()

    def whole(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("json", pa.bool_()), ("values", pa.list_(pa.string()))])

        def found(own, text):
            if own["depth"] < 0:  # no JSON: what is before the first brace of the file, for the parser to refuse
                return ([0], [text.index(b"}")]) if own["head"] else ([], [])
            starts, stops, listed, begun = cut(text, own)
            chosen = np.flatnonzero((listed & begun)[:-1])
            raw = np.frombuffer(text, np.uint8)
            told = np.append(np.flatnonzero((raw == _QUOTE) | (raw == _LIST) | (raw == _OBJECT)), len(raw))
            return np.minimum(told[np.searchsorted(told, starts[chosen])], stops[chosen]), stops[chosen]

        for own, data in placed_chunks(batches):
            starts, stops = found(own, data.to_pybytes())
            # Every other stretch between the borders is a record.
            borders = np.zeros(2 * len(starts) + 1, np.int32)
            borders[1::2], borders[2::2] = starts, stops
            texts = pa.Array.from_buffers(pa.string(), 2 * len(starts), [None, pa.py_buffer(borders), data])
            texts = texts.take(pa.array(np.arange(1, 2 * len(starts), 2)))
            values = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
            yield pa.RecordBatch.from_arrays([pa.array([own["path"]]), pa.array([own["depth"] >= 0]), values], schema=schema)

    def parts(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("ended_block", "ended_chunk", "block", "chunk")),
                            ("value", pa.binary()), ("closes", pa.bool_())])
        for own, data in placed_chunks(batches):
            if own["depth"] < 0:
                continue
            text, rows = data.to_pybytes(), []
            starts, stops, listed, begun = cut(text, own)
            before, here = (own["ended_block"], own["ended_chunk"]), (own["block"], own["chunk"])
            if len(starts) > 1 and listed[0] and not begun[0]:
                rows.append((own["path"], *before, *here, text[starts[0]:stops[0]], True))
            if listed[-1] and starts[-1] < stops[-1]:
                rows.append((own["path"], *(here if len(starts) > 1 else before), *here, text[starts[-1]:stops[-1]], False))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)

    return chunks, whole, parts


def json_records(spark: SparkSession, path: str | list[str], key: str | None = None) -> DataFrame:
    """The objects of one list per file, as text: ``path``, ``value``.

    The list is the file itself, or stands under ``key`` of the object that the file is; without a key, a file may also be
    an object or several, each a record. Files are split at closing braces, as others are at line ends, and the pieces of a
    split are joined to chunks of about 256 KB. A chunk turns the string state by its quotes and changes the depth of
    brackets by one of two amounts, as it begins outside or within a string; both are added up over the chunks of a file
    (one row a chunk, without its text), which tells state and depth at every chunk. Tasks then cut the chunks on their
    own; only what is left of records at the ends of chunks is brought together. No task holds more than a row group
    of chunks or a record.

    Elements that are no objects are left out, and so is an object that a file breaks off in. Without a key, a file that is
    no JSON at all gives what is before its first closing brace as a record, for the parser to refuse. Empty files and
    lists have no records; repeated objects are records of their own. The chunks are staged once: splits of a later scan
    could differ.
    """
    to_chunks, to_whole, to_parts = _worker(key)
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        F.concat("value", F.lit("}")).cast("binary").alias("value"))
    staged = scratch_path(spark, "json-chunks")
    # Small splits are put together, so that their chunks don't make a file each.
    measured = pieces.mapInArrow(to_chunks, _CHUNKS).hint("rebalance", "path", "block")
    measured.write.option("parquet.block.size", _ROW_GROUP_BYTES).parquet(staged)
    chunks = spark.read.parquet(staged)

    file = Window.partitionBy("path")
    order = file.orderBy("block", "chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    def as_entered(name: str) -> Column:
        return F.when(F.col("state") == 1, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    # One byte too many: no brace ends the file. A mark of byte order, three bytes, is not among the pieces.
    unclosed = (F.sum("bytes").over(file) - F.col("file_bytes")).isin(1, -2)
    if key:
        depth = F.lit(2)
    else:
        begins = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
        depth = F.when(begins == "[", 1).when(begins.isin("{", ""), 0).otherwise(-1)
    places = chunks.drop("text").withColumn("state", so_far("flips") % 2).withColumns(
        {"climb": as_entered("climb"), "low": as_entered("low"), "openings": as_entered("openings")})
    places = places.withColumns({
        "entered": so_far("climb"), "depth": depth, "head": F.row_number().over(order) == 1,
        "cut": unclosed & F.lead("chunk").over(order).isNull()})
    places = places.withColumns({
        "opened": F.try_element_at("openings", (F.col("depth") - F.col("entered")).cast("int")),
        "ended": F.when(F.col("entered") + F.col("low") <= F.col("depth"), F.struct("block", "chunk"))})
    had_ended = F.last("ended", ignorenulls=True).over(earlier)
    places = places.select(
        "path", "block", "chunk", "state", "entered", "depth", "head", "cut",
        F.coalesce(F.last("opened", ignorenulls=True).over(earlier), F.lit(False)).alias("was_open"),
        had_ended["block"].alias("ended_block"), had_ended["chunk"].alias("ended_chunk"))
    # Stored, so that Spark knows how small they are and sends them to the chunks.
    placed_at = scratch_path(spark, "json-places")
    places.write.parquet(placed_at)
    placed = chunks.select("path", "block", "chunk", "text").join(spark.read.parquet(placed_at), ["path", "block", "chunk"])

    whole = placed.mapInArrow(to_whole, _WHOLE).select("path", "json", F.explode("values").alias("value"))
    parts = F.array_sort(F.collect_list(F.struct("block", "chunk", "value")))
    joined = placed.mapInArrow(to_parts, _PARTS).groupBy("path", "ended_block", "ended_chunk").agg(
        F.bool_or("closes").alias("json"), F.array_join(F.transform(parts, lambda p: p["value"].cast("string")), "").alias("value"))
    records = whole.unionByName(joined.filter("json").select("path", "json", "value"))
    begins = F.startswith("value", F.lit("{"))
    bare = F.when(F.col("json") & ~begins, F.regexp_replace("value", "(?s)" + _SCALARS, "")).otherwise(F.col("value"))
    kept = records.withColumn("value", bare).filter(~F.col("json") | begins)
    return kept.select("path", F.make_valid_utf8("value").alias("value"))
