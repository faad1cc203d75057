"""Substring deduplication over content-defined chunks.

A gear rolling hash over the last bytes decides where a text may be cut, so equal passages are cut alike wherever they
stand, and an insertion moves only the cuts beside it. Chunks end after white space, and after any character where there
has been none for a while. A chunk whose digest occurred before, in the same text or in an earlier row, is a repeat;
repeats in a row are one run. Cuts lie some words inside a repeated passage, so each run is then grown to the whole match
by comparing the text beside it with that beside the first copies of its chunks.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.llm.common import forget_staged, in_batches, rows_of, stage, staged_so_far, text_or_empty, whole_row

#: The hash has 16 bits and so sees 16 bytes. A cut needs its first CUT_BITS bits to be 0 and white space before it, or
#: its first BARE_BITS bits and no white space in BARE_BYTES bytes, as in scripts that write none.
CUT_BITS = 3
BARE_BITS = 3
BARE_BYTES = 64
LEAST_BYTES = 24
MOST_BYTES = 512
#: These shifts look back over LOOK_BACK bytes, in which a cut is also one whose hash is the least.
LOOK_BACK = 64
STEPS = tuple(1 << i for i in range(LOOK_BACK.bit_length() - 1))
#: Words in a span of repeats from which it counts; short lines that many texts share are no passages.
LEAST_WORDS = 16
#: A word of more than LONG_WORD bytes counts as one for every WORD_BYTES beyond.
LONG_WORD = 24
WORD_BYTES = 6
#: Characters beside a run that are compared at first; matches that are longer are compared again with more.
REACH = 128
_SPACE = " \t\n\v\f\r"
_PAD = 16


@lru_cache(maxsize=1)
def _gear():
    """A pseudo-random 16-bit number per byte; 0 for byte 0, so that padding clears the hash."""
    import numpy as np
    from xxhash import xxh64_intdigest

    table = np.array([xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
    table[0] = 0
    return table


def cut_texts(texts: list[bytes], cut_bits: int = CUT_BITS, least: int = LEAST_BYTES, most: int = MOST_BYTES):
    """Per text its cuts as a list of byte offsets, 0 and its length included; and the joined, padded bytes with each
    text's place in them. The cuts of a text do not hang on the texts beside it.
    """
    import numpy as np

    pad = b"\0" * _PAD
    joined = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    rolled = _gear()[joined]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(rolled)
        older[step:] = rolled[:-step] << np.uint16(step)
        rolled = rolled + older
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    at_all = np.arange(len(joined), dtype=np.int32)
    bare = at_all - np.maximum.accumulate(np.where(space | (joined == 0), at_all, np.int32(0))) > BARE_BYTES
    bare[:-1] &= (joined[1:] & 0xC0) != 0x80  # not within a character
    chosen = space & (rolled < (1 << (16 - cut_bits))) | bare & (rolled < (1 << (16 - BARE_BITS)))
    # Text that repeats a few words may never have such a hash; there the least of the last bytes is as good a mark.
    least_before = np.where(space, rolled, np.uint16(0xFFFF))
    least_before[joined == 0] = 0
    for step in STEPS:
        least_before[step:] = np.minimum(least_before[step:], least_before[:-step])
    least_before[1:] = least_before[:-1]
    wanted = np.flatnonzero(chosen | space & (rolled <= least_before)) + 1
    places, at = [], _PAD
    for text in texts:
        places.append(at)
        at += len(text) + _PAD
    ends = [p + len(t) for p, t in zip(places, texts, strict=True)]
    low, high = np.searchsorted(wanted, places, "right"), np.searchsorted(wanted, ends)
    cuts = []
    for place, end, i, j in zip(places, ends, low.tolist(), high.tolist(), strict=True):
        found, last = [0], place
        for cut in [*wanted[i:j].tolist(), end]:
            while cut - last > most:
                last += most
                while joined[last] & 0xC0 == 0x80:  # not within a character
                    last -= 1
                found.append(last - place)
            if cut - last >= least or cut == end > last:
                found.append(cut - place)
                last = cut
        cuts.append(found)
    return cuts, joined, places


def _summed(marks):
    """How many marks are before each place."""
    import numpy as np

    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def chunk_table(rows: DataFrame) -> DataFrame:
    """Chunks of ``rows`` (row, id, text): (row, id, start, end, words, before, upto, d1, d2, again).

    Offsets count characters. ``before`` and ``upto`` count words from the text's begin to the chunk's start and end,
    long words by their bytes. ``d1`` and ``d2`` are a 128-bit digest of the chunk's bytes. ``again`` is where the chunk
    stood in the same text before, null if it did not. A null or empty text has no chunks.
    """

    def chunked(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            cuts, joined, places = cut_texts(texts)
            characters = _summed((joined & 0xC0) != 0x80)
            space = (joined == 32) | ((joined >= 9) & (joined <= 13))
            first = ~space
            first[1:] &= space[:-1] | (joined[:-1] == 0)
            words = _summed(first)
            within = np.arange(len(joined), dtype=np.int32)
            within -= np.maximum.accumulate(np.where(first, within, np.int32(0)))
            beyond = ~space & (within > LONG_WORD) & ((within - LONG_WORD) % WORD_BYTES == 0)
            counted = _summed(first | beyond)
            del space, first, within, beyond
            counts = np.array([len(c) - 1 for c in cuts])
            starts = np.array([p + x for p, c in zip(places, cuts, strict=True) for x in c[:-1]], np.int64)
            ends = np.array([p + x for p, c in zip(places, cuts, strict=True) for x in c[1:]], np.int64)
            digests, again = [], []
            for text, found in zip(texts, cuts, strict=True):
                own = [xxh3_128_digest(text[a:b]) for a, b in zip(found, found[1:], strict=False)]
                seen: dict[bytes, int] = {}
                for digest, start in zip(own, found, strict=False):
                    again.append(seen.setdefault(digest, start))
                digests += own
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(texts)), counts)
            place = np.array(places, np.int64)[of]
            base, earlier = characters[place], place + np.array(again, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(of)), batch.column("id").take(pa.array(of)),
                 pa.array((characters[starts] - base).astype(np.int32)), pa.array((characters[ends] - base).astype(np.int32)),
                 pa.array((words[ends] - words[starts]).astype(np.int32)),
                 pa.array((counted[starts] - counted[place]).astype(np.int32)),
                 pa.array((counted[ends] - counted[place]).astype(np.int32)), pa.array(np.ascontiguousarray(pairs[:, 0])),
                 pa.array(np.ascontiguousarray(pairs[:, 1])),
                 pa.array((characters[earlier] - base).astype(np.int32), mask=earlier == starts)],
                ["row", "id", "start", "end", "words", "before", "upto", "d1", "d2", "again"])

    schema = T.StructType([T.StructField("row", T.LongType()), rows.schema["id"]])
    for field in T.DataType.fromDDL("start int, end int, words int, before int, upto int, d1 bigint, d2 bigint, again int").fields:
        schema.add(field)
    return in_batches(rows, chunked, schema)


def _hits(rows: DataFrame) -> DataFrame:
    """Repeated chunks of ``rows``: (row, id, start, end, words, before, upto, first_row, first_id, first_start, run).

    Digests are counted before they are shuffled, and the join that marks copies may be split at a common chunk.
    """
    chunks = stage(chunk_table(rows), "chunks")
    new = chunks.filter("again is null")
    firsts = new.groupBy("d1", "d2").agg(F.min("row").alias("first_row"), F.min_by(F.struct("id", "start"), "row").alias("first"),
                                         F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    own = ["row", "id", "start", "end", "words", "before", "upto"]
    copied = new.join(firsts, ["d1", "d2"]).filter("row > first_row").select(
        *own, "first_row", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
    within = chunks.filter("again is not null").select(
        *own, F.col("row").alias("first_row"), F.col("id").alias("first_id"), F.col("again").alias("first_start"))
    order = Window.partitionBy("row").orderBy("start")
    marked = copied.union(within).withColumn("opens", (F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("start")).cast("int"))
    return marked.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def repeated_spans(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs of repeated whole chunks of ``rows`` (row, id, text): (row, id, start, end, words, first_ids).

    Of each chunk the first copy in the order of rows stays; ``first_ids`` are the ids of the rows that keep the span's
    chunks, a text's own for what it repeats itself. Spans under ``least_words`` words are left alone.
    """
    spans = _hits(rows).groupBy("row", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    return spans.filter(F.col("words") >= least_words).drop("run")


def repeated_passages(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Spans of ``rows`` (row, id, text) that repeat earlier text: (row, id, start, end, words, first_ids).

    Runs of repeated chunks, however short, each grown to whole words on both sides as far as the text equals that
    beside a first copy of one of its chunks. What touches is one span, and spans under ``least_words`` words are left
    alone. ``first_ids`` are the ids of the rows with the earlier text. ``rows`` are read twice and must not change.
    """
    mark = staged_so_far()
    hits = stage(_hits(rows), "hits")
    forget_staged(rows.sparkSession, mark, mark + 1)  # the chunks; hits are written by now
    order = Window.partitionBy("row").orderBy("run")
    runs = hits.groupBy("row", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("before").alias("before"),
        F.max("upto").alias("upto"), F.collect_set("first_id").alias("first_ids"))
    runs = runs.withColumns({"gap_left": F.col("start") - F.coalesce(F.lag("end").over(order), F.lit(0)),
                             "gap_right": F.coalesce(F.lead("start").over(order), F.lit((1 << 31) - 1)) - F.col("end")})
    runs = stage(runs, "runs")
    shift = (F.col("first_start") - F.col("start")).alias("shift")
    aligned = hits.groupBy("row", "run", "first_row", shift).agg(F.min("start").alias("from"), F.max("end").alias("to"))
    sides = F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.col("from").alias("at"), (F.col("from") - F.col("start")).alias("done"),
                 F.col("gap_left").alias("gap")),
        F.struct(F.lit(False).alias("left"), F.col("to").alias("at"), (F.col("end") - F.col("to")).alias("done"),
                 F.col("gap_right").alias("gap")))).alias("side")
    probes = aligned.join(runs.select("row", "run", "start", "end", "gap_left", "gap_right"), ["row", "run"]).select(
        "row", "run", "first_row", "shift", sides).select("row", "run", "first_row", "side.*", (
            F.col("side.at") + F.col("shift")).alias("first_at")).filter("gap > 0")
    probes, reach, grown = stage(probes, "probes"), REACH, None
    while True:
        mark = staged_so_far()
        found = stage(_compared(rows, probes, reach), "grown")
        forget_staged(rows.sparkSession, mark, mark + 1)  # the texts beside
        grown = found if grown is None else grown.unionByName(found)
        probes = found.filter("open").select(probes.columns)
        if probes.isEmpty():
            break
        reach *= 16
    best = grown.filter("grown > 0").groupBy("row", "run").agg(*(F.max(F.when(
        F.col("left") == left, F.struct("grown", "words"))).alias(name) for left, name in ((True, "l"), (False, "r"))))
    none = F.lit(0)
    whole = runs.join(best, ["row", "run"], "left").select(
        "row", "id", (F.col("start") - F.coalesce("l.grown", none)).alias("start"), (F.col("end") + F.coalesce("r.grown", none)).alias("end"),
        (F.col("before") - F.coalesce("l.words", none)).alias("before"), (F.col("upto") + F.coalesce("r.words", none)).alias("upto"), "first_ids")
    order = Window.partitionBy("row").orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = whole.withColumn("opens", (F.coalesce(so_far, F.lit(-1)) < F.col("start")).cast("int")).withColumn(
        "span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "span").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("upto") - F.min("before")).cast("bigint").alias("words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("first_ids")))).alias("first_ids"))
    return spans.filter(F.col("words") >= least_words).drop("span")


def _compared(rows: DataFrame, probes: DataFrame, reach: int) -> DataFrame:
    """``probes`` with how far the text beside ``at`` equals that beside ``first_at`` in the first row.

    ``grown`` and ``words`` are the characters and words won beyond ``done``, to a whole word; the characters up to ``done``
    are in the run already, and ``gap`` more lie before the next run. ``open`` tells that all within reach was equal.
    """
    length = F.least(F.col("gap"), F.lit(reach)) + F.col("done")
    asked = probes.select("row", "at", "left", length.alias("length")).union(
        probes.select("first_row", "first_at", "left", length)).groupBy("row", "at", "left").agg(F.max("length").alias("length"))
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("at", "left", "length")).alias("asked"))

    names = ["row", "at", "left", "beside"]

    def beside(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.bool_(), pa.string())
        for batch in batches:
            out = []
            for row, text, asked in zip(batch.column("row"), batch.column("text"), batch.column("asked"), strict=True):
                row, text, own = row.as_py(), text.as_py(), asked.values
                for at, left, length in zip(*(own.field(f).to_pylist() for f in ("at", "left", "length")), strict=True):
                    length += 1  # one more tells whether a word goes on
                    out.append((row, at, left, text[max(0, at - length):at] if left else text[at:at + length]))
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    texts = stage(in_batches(rows.select("row", "text").join(asked, "row"), beside, "row bigint, at int, left boolean, beside string"), "beside")
    firsts = texts.select(F.col("row").alias("first_row"), F.col("at").alias("first_at"), "left", F.col("beside").alias("first_beside"))
    both = probes.join(texts, ["row", "at", "left"]).join(firsts, ["first_row", "first_at", "left"])

    columns = probes.columns

    def compared(batches):
        import pyarrow as pa

        for batch in batches:
            out = [_grown(*values, reach) for values in rows_of(batch, "beside", "first_beside", "left", "done", "gap")]
            won = zip(*out, strict=True) if out else ((), (), ())
            types = (pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(c, t) for c, t in zip(won, types, strict=True))],
                [*columns, "grown", "words", "open"])

    schema = T.StructType(list(probes.schema.fields))
    for field in T.DataType.fromDDL("grown int, words int, open boolean").fields:
        schema.add(field)
    return in_batches(both, compared, schema)


def _grown(text: str, first: str, left: bool, done: int, gap: int, reach: int) -> tuple[int, int, bool]:
    """Characters and words by which ``text`` equals ``first`` beyond ``done``, and whether more may be equal."""
    if left:  # both are read from the run outwards
        text, first = text[::-1], first[::-1]
    most = done + min(gap, reach)
    low, high = 0, min(len(text), len(first), most)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if text[:middle] == first[:middle] else (low, middle - 1)
    if low <= done:
        return 0, 0, False
    if low == most and gap > reach:
        return 0, 0, True
    won = text[done:low]
    if low < len(text) and low < done + gap and text[low] not in _SPACE:
        kept = max(won.rfind(c) for c in _SPACE) + 1  # what follows is part of a word that goes on
        ends = min((text + c).index(c, low) for c in _SPACE)
        if len(text[done + kept:ends].encode()) <= LONG_WORD:
            won = won[:kept]
    return len(won), sum(1 + max(0, len(w) - LONG_WORD - 1) // WORD_BYTES for w in won.encode().split()), False


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       text_or_empty(text_col).alias("text"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with repeated spans cut out of their texts; a text that is all repeats becomes empty.

    Columns are those of the input; a null text stays null.
    """
    held = stage(docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs")
    rows = held.select("row", F.col(f"doc.{id_col}").alias("id"), text_or_empty(f"doc.{text_col}").alias("text"))
    spans = repeated_passages(rows, least_words).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    schema = held.schema["doc"].dataType

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            doc, texts = batch.column("doc"), []
            for text, found in rows_of(batch, "text", "spans"):
                if text is not None and found:
                    bounds = [0, *(x for s in found for x in (s["start"], s["end"])), len(text)]
                    text = "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                texts.append(text)
            fields = [pa.array(texts, f.type) if f.name == text_col else doc.field(i) for i, f in enumerate(doc.type)]
            yield pa.RecordBatch.from_arrays(fields, [f.name for f in doc.type])

    joined = held.join(spans, "row", "left").select("doc", F.col(f"doc.{text_col}").alias("text"), "spans")
    return in_batches(joined, cut, schema)
