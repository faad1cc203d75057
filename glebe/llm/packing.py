"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram with at most ``capacity`` bars.
The packing is worked out on that histogram: a plan of patterns with multiplicities, whose size does not grow with
the corpus. Spark counts the histogram, numbers the pieces of each length, and looks each number up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glebe.llm.common import byte_pair_encoding, in_batches, rows_of, stage, text_or_empty

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: its id, piece number, start, length and ids.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Only a document longer
    than ``capacity`` is cut, into pieces of ``capacity``; the first piece takes what is over. ``ids`` holds unsigned
    little-endian 32-bit numbers. Repeated rows and null ids are documents of their own.
    """

    def encoded(batches):
        import numpy as np
        import pyarrow as pa

        encoder = byte_pair_encoding(vocabulary)
        names = [id_col, "piece", "start", "length", "ids"]

        def table(rows, kind):
            columns = list(zip(*rows, strict=True))
            types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            rows, size = [], 0
            kind = batch.schema.field("key").type
            for key, text in rows_of(batch, "key", "text"):
                ids = np.array([*encoder.encode_ordinary(text), end_id], "<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for number, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((key, number, start, end - start, ids[start:end].tobytes()))
                size += len(ids)
                if size > 1_000_000:
                    yield table(rows, kind)
                    rows, size = [], 0
            if rows:
                yield table(rows, kind)

    key = F.col(id_col)
    kind = docs.select(key).schema[0].dataType.simpleString()
    kind = "string" if kind == "void" else kind
    keyed = docs.select(key.cast(kind).alias("key"), text_or_empty(text_col).alias("text"))
    return in_batches(keyed, encoded, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary")


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: their place in sequences of at most ``capacity``.

    Sequences have no gaps and are numbered from 0. Equal lengths are exchangeable; which of them goes where is
    settled by the staged order. Input columns named ``sequence_id`` or ``offset`` are replaced. A length outside
    1 to ``capacity``, or null, is an error.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    staged = stage(pieces.select(F.struct(*kept).alias("piece"), F.col(length_col).cast("bigint").alias("length"),
                                 F.monotonically_increasing_id().alias("row")), "pieces")
    staged = staged.withColumn("part", F.shiftright("row", 33))
    counts = staged.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select("length", "part", "count",
                                 F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "piece-counts")
    # At most `capacity` rows come to the driver.
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("count").alias("n"))
                 .orderBy("length").limit(capacity + 2).collect()}
    if any(length is None or not 1 <= length <= capacity for length in histogram):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    plan = spark.createDataFrame(packing_plan(histogram, capacity),
                                 "length bigint, low bigint, high bigint, base bigint, offset bigint, copies bigint")
    order = Window.partitionBy("length", "part").orderBy("row")
    numbered = (staged.withColumn("nth", F.row_number().over(order))
                .join(starts.select("length", "part", "first"), ["length", "part"])
                .withColumn("nth", F.col("first") + F.col("nth") - 1))
    # The plan's size is bounded by the capacity alone, see packing_plan.
    placed = numbered.join(F.broadcast(plan), (numbered.length == plan.length) & (F.col("nth") >= F.col("low"))
                           & (F.col("nth") < F.col("high")))
    at = F.col("nth") - F.col("low")
    return placed.select("piece.*", (F.col("base") + F.floor(at / F.col("copies"))).alias("sequence_id"),
                         (F.col("offset") + F.pmod(at, F.col("copies")) * plan.length).alias("offset"))


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, low, high, base, offset, copies).

    The pieces of that length numbered low to high - 1 go to sequences base, base + 1, ..., so many copies to each, from
    that offset on. A length adds at most four patterns to the plan, and a pattern has fewer different lengths than the
    square root of twice the capacity: under 4 * 2048 * 64 rows for a capacity of 2048, whatever the corpus.
    """
    left = {size: n for size, n in histogram.items() if n}
    patterns = _dominating_sets(left, capacity)
    patterns += _best_fit(left, capacity)
    plan, used, base = [], dict.fromkeys(histogram, 0), 0
    for sizes, times in patterns:
        offset = 0
        for size, copies in sizes:
            plan.append((size, used[size], used[size] + times * copies, base, offset, copies))
            used[size] += times * copies
            offset += size * copies
        base += times
    return plan


#: Lengths with their copies in one sequence.
Pattern = tuple[tuple[int, int], ...]


def _dominating_sets(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sets that dominate every other set holding their largest piece; taken out of ``left`` for good.

    A set dominates another if the other's pieces, grouped, fit into its pieces one for one, so an optimal packing
    with the set exists. Taking pieces away only shrinks the alternatives; a proof once made stays valid.
    """
    fixed = []

    def fix(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((tuple((size, sizes.count(size)) for size in dict.fromkeys(sizes)), times))
        for size in sizes:
            left[size] -= times
            if not left[size]:
                del left[size]

    def times_of(sizes: tuple[int, ...]) -> int:
        return min(left[size] // sizes.count(size) for size in sizes)

    if capacity in left:
        fix((capacity,), left[capacity])
    # An exact pair dominates: whatever else joins the larger piece fits into the smaller one.
    for size in sorted(left, reverse=True):
        pair = (size, capacity - size)
        if size in left and size * 2 >= capacity and pair[1] in left and (times := times_of(pair)):
            fix(pair, times)
    changed = True
    while changed:
        changed = False
        for size in sorted(left, reverse=True):
            while size in left and (found := _dominating_set(left, size, capacity)):
                if not (times := times_of(found)):
                    break
                fix(found, times)
                changed = True
    return fixed


def _dominating_set(left: dict[int, int], size: int, capacity: int) -> tuple[int, ...] | None:
    """A dominating set of at most three pieces around one piece of ``size``, if one can be proven."""
    room = capacity - size
    others = dict(left)
    others[size] -= 1
    sizes = sorted(s for s, n in others.items() if n)
    smallest: list[int] = []
    for s in sizes:
        smallest += [s] * min(others[s], 3 - len(smallest))
        if len(smallest) == 3:
            break
    if not smallest or smallest[0] > room:
        return (size,)
    most = sizes[bisect_right(sizes, room) - 1]
    if len(smallest) < 2 or sum(smallest[:2]) > room:
        return (size, most)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # At most two more pieces fit. A single one is no larger than `most`.
    if _largest_pair(sizes, others, room) <= most:
        return (size, most)
    others[most] -= 1
    partners = [s for s in sizes if others[s] and s <= room - most]
    if partners:
        above = bisect_right(sizes, partners[-1])
        # Every pair has a part no larger than the second piece, since two larger ones exceed the room.
        if above == len(sizes) or 2 * sizes[above] > room:
            return (size, most, partners[-1])
    return None


def _largest_pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    best, low, high = 0, 0, bisect_left(sizes, room) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and counts[sizes[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, largest first, of what is left; equal sequences are handled as one pattern with a multiplicity."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}

    def put(sizes: Pattern, room: int, size: int, bins: int, count: int) -> int:
        """Fill equal sequences with up to ``count`` pieces, one sequence after another; the pieces used."""
        each = room // size
        full = min(bins, count // each)
        rest = min(count - full * each, each - 1) if full < bins else 0
        for times, copies in ((full, each), (1 if rest else 0, rest), (bins - full - bool(rest), 0)):
            if times:
                more = ((size, copies),) if copies else ()
                open_.setdefault(room - copies * size, []).append((sizes + more, times))
        return full * each + rest

    for size in sorted(left, reverse=True):
        count = left[size]
        for room in sorted(r for r in open_ if r >= size):
            for sizes, bins in open_.pop(room) if count else ():
                if count:
                    count -= put(sizes, room, size, bins, count)
                else:
                    open_.setdefault(room, []).append((sizes, bins))
        if count:
            each = capacity // size
            put((), capacity, size, -(-count // each), count)
    return [pattern for patterns in open_.values() for pattern in patterns]
