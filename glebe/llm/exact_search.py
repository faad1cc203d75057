"""Exact top-k search by no-random-access aggregation.

Rows are dealt to blocks, and a block to segments. A segment keeps one list per component, sorted by its value; a query
reads the lists from their better ends, all to one depth, deeper round by round. A row's lower bound takes the worst value
of every list it has not yet been read in, its upper bound the value that list was last read at. Reading stops when few rows
are left whose upper bound reaches the k-th lower bound, or the k-th score of the segments before; all others, read or not,
cannot qualify, and the scores of the few are resolved. The best of all blocks are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.llm.common import in_batches, stage

K = 10
SCALE = 1024
#: Components of a block's rows at most, about, which bounds a task's memory; and blocks that a small table is dealt to.
BLOCK_VALUES = 1 << 21
BLOCKS = 64
BLOCK_ROWS = 16_384
#: Rows that share a set of lists.
SEGMENT = 2048
#: Parts of the lists to which they are read before the bounds are compared.
DEPTHS = (1 / 16, 5 / 8, 3 / 4, 7 / 8, 15 / 16, 1)
#: Rows that may be left when reading stops, as a multiple of k; their scores are resolved.
LEFT = 25


def quantised(vector: str, scale: int = SCALE) -> Column:
    """The components times the scale, floored."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    return F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))


def search(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K,
           scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``queries`` picks, its k rows of largest integer inner product.

    Exact at every size. A query's own id is no candidate; ties go to the smaller id; fewer candidates give fewer rows.
    Vectors that are not usable, and rows without an id, take no part; zero vectors do. Vectors are compared with those
    of their own length. Repeated rows, and rows that share an id, are candidates and queries each. A score that does not
    fit 64 bits is an error.
    """
    kind = rows.schema[id_col].dataType
    asks = F.coalesce(queries, F.lit(False))
    # Equal rows are one row with a count, however many; then any dealing is even.
    distinct = rows.filter(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), quantised(vector, scale).alias("v"), asks.alias("asks")).groupBy("id", "v").agg(
            F.count("*").alias("n"), F.count_if("asks").alias("n_asks"))
    sound = stage(distinct.withColumn("row", F.monotonically_increasing_id()), "vectors")
    length = F.size("v")
    sizes = sound.groupBy(length.alias("length")).agg(F.count("*").alias("rows"))
    share = F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("rows") / BLOCKS))
    share = F.greatest(F.lit(1), F.least(share, F.floor(F.lit(BLOCK_VALUES) / F.greatest("length", F.lit(1)))))
    blocks = sizes.select(F.col("length").alias("of_length"), F.ceil(F.col("rows") / share).alias("blocks"))
    dealt = sound.join(blocks, length == F.col("of_length"))
    held = dealt.withColumn("asking", F.lit(False)).withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    asked = dealt.filter("n_asks > 0").withColumn("asking", F.lit(True)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    columns = ["of_length", "block", "asking", "row", "id", "v", "n", "n_asks"]
    both = held.select(columns).unionAll(asked.select(columns)).repartition("of_length", "block").sortWithinPartitions(
        "of_length", "block", "asking", "row")
    schema = T.StructType().add("row", "long").add("query_id", kind).add("n_asks", "long").add("id", kind).add(
        "score", "long").add("n", "long")

    def find(batches):
        import numpy as np
        import pyarrow as pa

        block, ready, waiting = None, None, []
        types = [pa.int64(), None, pa.int64(), None, pa.int64(), pa.int64()]
        for batch in batches:
            types[1] = types[3] = batch.schema.field("id").type
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("of_length", "block", "asking")]
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            found = []
            for low, high in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if (here := (keys[0][low], keys[1][low])) != block:
                    block, ready, waiting = here, None, []
                part = batch.slice(low, high - low)
                if not keys[2][low]:
                    waiting.append(part)
                    continue
                if ready is None and waiting:
                    ready, waiting = Block(*_columns(waiting, block[0])), []
                if ready is not None:
                    ids, vectors, _ = _columns([part], block[0])
                    for row, own, n_asks, q in zip(part.column("row").to_pylist(), ids, part.column("n_asks").to_pylist(), vectors, strict=True):
                        found += [(row, own, n_asks, *hit) for hit in ready.best(q, own, k)]
            values = zip(*found, strict=True) if found else ((),) * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], schema.names)

    hits = in_batches(both, find, schema)
    copies = hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k)))))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    best = copies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.withColumn("ask", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_asks"))).select("query_id", "rank", "id", "score")


def _columns(batches, length: int):
    """Ids, vectors and counts of Arrow batches with vectors of one length."""
    import numpy as np

    ids = [x for b in batches for x in b.column("id").to_pylist()]
    vectors = np.concatenate([b.column("v").flatten().to_numpy() for b in batches]).reshape(len(ids), int(length))
    return ids, vectors, np.concatenate([b.column("n").to_numpy() for b in batches])


class Block:
    """Rows in segments, which a query reads one after the other: what it has found is a bound for the next."""

    def __init__(self, ids: list, vectors, counts):
        self.segments = [Segment(ids[at:at + SEGMENT], vectors[at:at + SEGMENT], counts[at:at + SEGMENT])
                         for at in range(0, len(ids), SEGMENT)]

    def best(self, query, own, k: int) -> list[tuple]:
        """(id, score, count) of the k best rows for a query, but those of its own id."""
        found: list[tuple] = []
        for segment in self.segments:
            at_least = found[k - 1][1] if len(found) >= k else None
            found = sorted(found + segment.candidates(query, own, k, at_least), key=lambda hit: (-hit[1], hit[0]))[:k]
        return found


class Segment:
    """Rows with one sorted list per component, to be read from either end."""

    def __init__(self, ids: list, vectors, counts):
        import numpy as np

        self.ids, self.vectors, self.counts = ids, vectors, counts
        self.names = np.empty(len(ids), object)
        self.names[:] = ids
        if isinstance(ids[0], int):
            self.names = np.array(ids)
        order = np.argsort(vectors.T, axis=1, kind="stable")
        values = np.take_along_axis(vectors.T, order, axis=1).astype(np.float64)
        self.largest = np.abs(values).max(axis=1, initial=0.0)
        # All lists from their small ends, then all from their large ends.
        self.rows, self.values = (np.concatenate([x, x[:, ::-1]]) for x in (order, values))

    def candidates(self, query, own, k: int, at_least=None) -> list[tuple]:
        """(id, score, count) of the rows, but those of the query's own id, that may be among the k best; ``at_least``
        is a score that k rows elsewhere have."""
        import numpy as np

        weights = query.astype(np.float64)
        if float(np.abs(weights) @ self.largest) >= 2.0**63:
            raise OverflowError("a score does not fit 64 bits")
        left = self._left(weights, np.flatnonzero(self.names != own), k, at_least)
        scores = (self.vectors[left] @ query).tolist()
        return [(self.ids[i], score, n) for i, score, n in zip(left, scores, self.counts[left].tolist(), strict=True)]

    def _left(self, query, able, k: int, at_least):
        """The rows whose upper bound reaches the k-th lower bound, when these are few or the lists are read far enough."""
        import numpy as np

        n, heavy = len(self.ids), np.flatnonzero(query)
        # A list is read from the end that has its largest products; where the weight is 0 all products are 0.
        lists, weights = np.where(query < 0, 0, len(query))[heavy] + heavy, query[heavy]
        worst = self.values[lists, -1] * weights
        # Sums of products may be off by so much; below a half, whole numbers stay apart.
        slack = float(np.abs(query) @ self.largest) * 2.0**-48
        few, left = LEFT * k, able
        for share in DEPTHS:
            if len(left) <= few:
                break
            depth = max(1, int(n * share))
            rows, products = self.rows[lists, :depth], self.values[lists, :depth]
            products *= weights[:, None]
            floor = at_least
            if at_least is None:
                floor = np.partition(self._sums(rows, products, worst)[able], len(able) - k)[len(able) - k] - slack
            left = able[self._sums(rows, products, products[:, -1])[able] + slack >= floor]
        return left

    def _sums(self, rows, products, others):
        """Per row its products read, and for lists it was not read in what ``others`` has for them."""
        import numpy as np

        return others.sum() + np.bincount(rows.ravel(), (products - others[:, None]).ravel(), len(self.ids))
