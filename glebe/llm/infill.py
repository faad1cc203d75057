"""Fill-in-the-middle texts by displacement scatter.

Spark cuts each text at two code points drawn by hash and picks its form. A batch of texts is then one buffer of bytes:
a scan finds the bytes at which the cuts lie, a difference array holds by how much the output shift changes there, its
cumulative sum is the shift of every byte, and one scatter writes all outputs of the batch. The inverse scans the output
for the sentinels, builds the shifts of the restored bytes alike and gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.llm.common import in_batches, text_or_empty, whole_row

#: Fixed marks before prefix, suffix and middle; three ASCII bytes each, told apart by the second.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = 3
#: Of hundred texts, those left plain at least, and the others' suffix-first share.
PLAIN_FROM = 90
SUFFIX_FIRST_BELOW = 20
#: Bytes whose shifts are in memory at a time, eight bytes each.
BLOCK = 1 << 20


def draws(id_col: str, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
        carry: list[str] | None = None) -> DataFrame:
    """Each row as ``doc`` (its columns in ``carry``, all by default) with ``text``, ``n`` code points, ``form`` and the
    ends of prefix and middle, ``first`` and ``second``, in code points; 0 where the form is plain.

    Plain are empty and null texts, texts that hold a mark, and those that the draw leaves plain. The draws hang on the
    id alone, so a repeated row is cut alike. Columns of the input are never looked at but for id and text.
    """
    h1, h2, h3, h4 = draws(f"doc.`{id_col}`", seed)
    text = text_or_empty(f"doc.`{text_col}`")
    plain = (F.col("n") == 0) | (h3 % 100 >= PLAIN_FROM)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    rows = docs.select(whole_row(docs).alias("doc")).withColumn("text", text)
    rows = rows.withColumn("n", F.length("text").cast("bigint")).withColumn(
        "form", F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm"))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cuts = F.when(F.col("form") == "plain", F.array(F.lit(0), F.lit(0)).cast("array<bigint>")).otherwise(
        F.array_sort(F.array(one, two)))
    doc = F.struct(*(F.col(f"doc.`{c}`") for c in (docs.columns if carry is None else carry)))
    return rows.withColumn("cuts", cuts).select(
        doc.alias("doc"), "text", "n", "form", F.col("cuts")[0].alias("first"), F.col("cuts")[1].alias("second"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   carry: list[str] | None = None) -> DataFrame:
    """Each row as ``doc`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Form psm is mark and prefix, mark and suffix, mark and middle; spm has the suffix first; plain is the text. An empty
    or null text gives an empty output. A long text is a batch of its own.
    """
    rows = cut(docs, id_col, text_col, seed, carry)

    def scatter(batches):
        import pyarrow as pa

        for batch in batches:
            data, ends = _buffer(batch.column("text"))
            columns = (batch.column(c).to_numpy() for c in ("n", "first", "second"))
            forms = batch.column("form").to_numpy(zero_copy_only=False)
            out, out_ends = _scatter(data, ends, forms, *columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc", "n", "form", "first", "second")] + [_strings(out, out_ends)],
                ["doc", "n", "form", "first", "second", "output"])

    moved = in_batches(rows, scatter, _without(rows, "text").add("output", "string"))
    hidden = F.col("form") == "plain"
    return moved.select("doc", "n", "form", F.when(~hidden, F.col("first")).alias("prefix_chars"),
                        F.when(~hidden, F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restore(filled: DataFrame, output_col: str = "output", form_col: str = "form",
            restored_col: str = "restored") -> DataFrame:
    """The rows with the texts rebuilt from output and form alone, in ``restored_col`` instead of the output.

    A null output is restored to null. An output that has not its form's three marks in order is an error.
    """

    def gather(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column(output_col)
            data, ends = _buffer(column)
            forms = batch.column(form_col).to_numpy(zero_copy_only=False)
            texts = _strings(*_gather(data, ends, forms))
            if column.null_count:
                texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            names = [n for n in batch.schema.names if n != output_col]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [texts], [*names, restored_col])

    return in_batches(filled, gather, _without(filled, output_col).add(restored_col, "string"))


def _without(df: DataFrame, column: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != column])


def _buffer(column):
    """The bytes of all texts of an Arrow column in a row, and where each text starts, the end of the last added."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # Nulls become empty texts, and own no bytes then.
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_[places[0]:places[-1]], places - places[0]


def _strings(data, ends):
    """An Arrow column of the texts that lie in a row in ``data``."""
    import numpy as np
    import pyarrow as pa

    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _shifts(size: int, at, shift):
    """Blocks (start, end, shift of each byte): from place at[i] on, bytes are moved by shift[i]; ``at`` ascends.

    The steps between the shifts are put into a difference array, whose cumulative sum goes on from block to block.
    """
    import numpy as np

    steps = np.diff(shift, prepend=0)
    carried = 0
    for start in range(0, size, BLOCK):
        end = min(start + BLOCK, size)
        low, high = np.searchsorted(at, [start, end])
        difference = np.zeros(end - start, np.int64)
        np.add.at(difference, at[low:high] - start, steps[low:high])
        difference[0] += carried
        moved = np.cumsum(difference)
        carried = moved[-1]
        yield start, end, moved


def _places(data, points):
    """The byte at which each code point of ascending numbers starts; one past the end for the number of all."""
    import numpy as np

    places = np.full(len(points), len(data), np.int64)
    seen = 0
    for start in range(0, len(data), BLOCK):
        begins = np.flatnonzero((data[start:start + BLOCK] & 0xC0) != 0x80)
        low, high = np.searchsorted(points, [seen, seen + len(begins)])
        places[low:high] = start + begins[points[low:high] - seen]
        seen += len(begins)
    return places


def _scatter(data, ends, forms, n, first, second):
    """Output bytes of all texts of a buffer, and where each output starts."""
    import numpy as np

    base = np.concatenate([[0], np.cumsum(n)])[:-1]
    cuts = _places(data, np.stack([base + first, base + second], axis=1).ravel()).reshape(-1, 2)
    start, end = ends[:-1], ends[1:]
    marked, flipped = forms != "plain", forms == "spm"
    # What is cut nowhere is all suffix, so that plain texts are moved as a whole.
    a, b = np.where(marked, cuts[:, 0], start), np.where(marked, cuts[:, 1], start)
    prefix, suffix = a - start, end - b
    out_ends = np.concatenate([[0], np.cumsum(end - start + 3 * _MARK * marked)])
    out = out_ends[:-1]
    ahead = np.where(flipped, suffix, prefix)  # the length of the segment that comes first
    to_prefix = out + np.where(flipped, suffix + 2 * _MARK, _MARK * marked)
    to_suffix = out + np.where(flipped, _MARK, (prefix + 2 * _MARK) * marked)
    to_middle = out + (prefix + suffix + 3 * _MARK) * marked
    at = np.stack([start, a, b], axis=1).ravel()
    shift = np.stack([to_prefix - start, to_middle - a, to_suffix - b], axis=1).ravel()
    result = np.empty(out_ends[-1], np.uint8)
    for low, high, moved in _shifts(len(data), at, shift):
        result[np.arange(low, high) + moved] = data[low:high]
    for pick, places in ((marked & ~flipped, (out, out + ahead + _MARK)), (flipped, (out + ahead + _MARK, out))):
        for mark, place in zip((PREFIX, SUFFIX), places, strict=True):
            _write(result, place[pick], mark)
    _write(result, (to_middle - _MARK)[marked], MIDDLE)
    return result, out_ends


def _write(data, places, mark: str) -> None:
    import numpy as np

    data[places[:, None] + np.arange(_MARK)] = np.frombuffer(mark.encode(), np.uint8)


def _gather(data, ends, forms):
    """Texts of all outputs of a buffer, and where each starts."""
    import numpy as np

    start, end = ends[:-1], ends[1:]
    marked, flipped = forms != "plain", forms == "spm"
    opens, closes = (np.frombuffer(c.encode(), np.uint8)[0] for c in "<>")
    names = np.frombuffer((PREFIX[1] + SUFFIX[1] + MIDDLE[1]).encode(), np.uint8)
    found = np.flatnonzero((data[:-2] == opens) & (data[2:] == closes) & np.isin(data[1:-1], names)) if len(data) > 2 else \
        np.zeros(0, np.int64)
    # A plain text may hold marks of its own, and any text may seem to make one with the text after it.
    of = np.searchsorted(ends, found, side="right") - 1
    found = found[marked[of] & (found + _MARK <= ends[of + 1])]
    found = found.reshape(-1, 3) if len(found) == 3 * marked.sum() else None
    wanted = np.where(flipped[marked][:, None], [names[1], names[0], names[2]], names)
    if found is None or (data[found + 1] != wanted).any() or (found[:, 0] != start[marked]).any():
        raise ValueError("an output does not hold the marks of its form")
    one, two, three = (np.zeros(len(start), np.int64) for _ in range(3))
    one[marked], two[marked], three[marked] = found.T
    first_at, second_at, middle_at = one + _MARK, two + _MARK, three + _MARK
    first, second = two - first_at, three - second_at
    from_prefix = np.where(marked, np.where(flipped, second_at, first_at), start)
    from_suffix = np.where(marked, np.where(flipped, first_at, second_at), start)
    prefix = np.where(marked, np.where(flipped, second, first), 0)
    middle = np.where(marked, end - middle_at, 0)
    text_ends = np.concatenate([[0], np.cumsum(end - start - 3 * _MARK * marked)])
    to = text_ends[:-1]
    at = np.stack([to, to + prefix, to + prefix + middle], axis=1).ravel()
    shift = np.stack([from_prefix - to, middle_at - (to + prefix), from_suffix - (to + prefix + middle)], axis=1).ravel()
    result = np.empty(text_ends[-1], np.uint8)
    for low, high, moved in _shifts(len(result), at, shift):
        result[low:high] = data[np.arange(low, high) + moved]
    return result, text_ends
