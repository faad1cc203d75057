"""Nearest neighbours by learned partitions of a neighbour graph.

The index is fitted on a bounded sample: its neighbour graph is cut into balanced parts, and a small classifier learns
which part a vector belongs to. Every row of the table is then put into the part the classifier finds most probable,
and a query is routed to its most probable parts, as many as a validation on the sample asks for, and compared there
with every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glebe.llm.common import in_batches, stage

K = 20
#: Vectors the index is fitted on, at most. They are the ones with the least hashes of their ids.
SAMPLE = 8_000
#: The number of parts is the square root of the rows over this, at most MOST_PARTS. More parts mean less to compare and
#: more partial results to merge.
ROOT_SHARE = 8
MOST_PARTS = 256
NEIGHBOURS = 16
#: Share of the held-out points' true neighbours that the routed parts must hold, and how many points one is held out of.
WANTED = 0.98
HELD_OUT = 8
#: Rows of a part compared by one call; a larger part is several blocks.
BLOCK_ROWS = 4_096
QUERY_ROWS = 1_024
_HIDDEN = 96


@dataclass(frozen=True)
class Index:
    """Weights of the classifier, and to how many parts a query goes."""

    weights: Any
    parts: int
    probes: int
    dimensions: int

    def probabilities(self, vectors):
        """Parts' log-odds for each row of an array of vectors."""
        import numpy as np

        w1, b1, w2, b2 = self.weights
        return np.maximum(_inputs(vectors) @ w1 + b1, 0) @ w2 + b2


def _inputs(vectors):
    """Direction and length; finite however long the vector."""
    import numpy as np

    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    return np.concatenate([scaled / norm * np.sqrt(vectors.shape[1]), np.log(scale) + np.log(norm)], axis=1)


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, and not zero."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, n_rows: int, sample: int = SAMPLE, k: int = K) -> Index | None:
    """The index for ``vectors`` (id, v), from at most ``sample`` of them; None if there are none.

    Vectors must have one length. The sample and all sizes here are bounded by parameters, so the fit runs in the
    driver whatever the table's size.
    """
    import numpy as np

    # Distinct vectors only: copies would be each other's only neighbours. One copied vector has one hash. Hashes alone
    # are made distinct and ordered; vectors are gathered only for the least ones.
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not least:
        return None
    rows = hashed.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.first("v").alias("v")).orderBy("h")
    points = np.array([r.v for r in rows.collect()], np.float64)
    held = np.arange(len(points)) % HELD_OUT == HELD_OUT - 1
    known = points[~held]
    parts = int(max(1, min(MOST_PARTS, n_rows**0.5 // ROOT_SHARE, len(known) // (2 * NEIGHBOURS))))
    near = _graph(known, min(NEIGHBOURS, len(known) - 1))
    of = _balanced_parts(near, parts)
    weights = _classifier(_inputs(known), of, near, parts)
    index = Index(weights, parts, 1, points.shape[1])
    return Index(weights, parts, _probes(index, points, held, k) if parts > 1 else 1, points.shape[1])


def _graph(points, k: int):
    """The k neighbours of largest inner product of each point."""
    import numpy as np

    near = np.empty((len(points), k), np.int64)
    for at in range(0, len(points), 512):
        products = points[at:at + 512] @ points.T
        products[np.arange(len(products)), np.arange(at, at + len(products))] = -np.inf
        near[at:at + 512] = np.argpartition(-products, k - 1, axis=1)[:, :k] if k else near[at:at + 512]
    return near


def _balanced_parts(near, parts: int):
    """Parts of nearly equal size with few edges between: halves along the slowest mode of the graph, again and again,
    each then bettered by swapping pairs of points that lower the cut."""
    import numpy as np

    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if k else np.empty((0, 2), np.int64)
    of = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    random = np.random.default_rng(5)
    while todo:
        points, first, count = todo.pop()
        if count == 1:
            of[points] = first
            continue
        place = np.full(n, -1)
        place[points] = np.arange(len(points))
        own = place[edges]
        own = own[(own >= 0).all(axis=1)]
        left = count // 2
        side = _halved(own, len(points), len(points) * left // count, random)
        todo += [(points[side], first, left), (points[~side], first + left, count - left)]
    return of


def _halved(edges, n: int, left: int, random):
    import numpy as np

    a, b = edges.T if len(edges) else (np.empty(0, np.int64),) * 2
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-3
    mode = random.standard_normal(n)
    for _ in range(60):
        mode -= (degree * mode).sum() / degree.sum()
        spread = np.bincount(a, mode[b], n) + np.bincount(b, mode[a], n)
        mode = mode + spread / degree
        mode /= np.abs(mode).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[:left]] = True
    for _ in range(8):
        s = np.where(side, 1.0, -1.0)
        gain = -s * (np.bincount(a, s[b], n) + np.bincount(b, s[a], n))  # edges lost less edges won by moving
        here, there = np.flatnonzero(side), np.flatnonzero(~side)
        here, there = here[np.argsort(-gain[here], kind="stable")], there[np.argsort(-gain[there], kind="stable")]
        m = min(len(here), len(there))
        swap = np.flatnonzero(gain[here[:m]] + gain[there[:m]] > 0)
        swap = swap[:max(1, len(swap) // 2)]
        if not len(swap):
            break
        side[here[swap]], side[there[swap]] = False, True
    return side


def _classifier(inputs, of, near, parts: int, rounds: int = 40):
    """One hidden layer, trained towards the parts of a point and of its neighbours."""
    import numpy as np

    random = np.random.default_rng(7)
    n, size = inputs.shape
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.arange(n), of), 1.0)
    for column in near.T:
        np.add.at(wanted, (np.arange(n), of[column]), 1.0 / near.shape[1])
    wanted /= wanted.sum(axis=1, keepdims=True)
    weights = [random.standard_normal((size, _HIDDEN)) * np.sqrt(2 / size), np.zeros(_HIDDEN),
               random.standard_normal((_HIDDEN, parts)) * np.sqrt(1 / _HIDDEN), np.zeros(parts)]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for round_ in range(rounds):
        for rows in np.array_split(random.permutation(n), max(1, n // 128)):
            x = inputs[rows]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            odds = hidden @ weights[2] + weights[3]
            chance = np.exp(odds - odds.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            back = (chance - wanted[rows]) / len(rows)
            inner = (back @ weights[2].T) * (hidden > 0)
            step += 1
            for i, slope in enumerate((x.T @ inner, inner.sum(0), hidden.T @ back, back.sum(0))):
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                rate = 2e-3 * (1 - round_ / rounds) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * mean[i] / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def _probes(index: Index, points, held, k: int) -> int:
    """The fewest parts that hold the wanted share of the k neighbours of the points held out of the training, where
    the classifier puts them.

    The sample's neighbours lie further off than those among all rows, so the share errs low.
    """
    import numpy as np

    asking = np.flatnonzero(held)
    products = points[asking] @ points.T
    products[np.arange(len(asking)), asking] = -np.inf
    k = min(k, len(points) - 1)
    near = np.argpartition(-products, k - 1, axis=1)[:, :k]
    odds = index.probabilities(points)
    rank = np.argsort(np.argsort(-odds[asking], axis=1), axis=1)
    at = np.take_along_axis(rank, odds.argmax(axis=1)[near], axis=1)
    for probes in range(1, index.parts + 1):
        if (at < probes).mean() >= WANTED:
            return probes
    return index.parts


def search(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K,
           sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``queries`` picks, its k rows of largest inner product found.

    A query's own row (its id) is no candidate; ties go to the smaller id; scores are exact, in double precision.
    Vectors that are not usable, and rows without an id, take no part. Vectors are compared with those of their own
    length. Every row is in one part, and a part of any size is compared block by block.
    Rows that share an id are candidates and queries each.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    sound = stage(rows.filter(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    lengths = {r.length: r.n_rows for r in sound.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n_rows")).collect()}
    if not lengths:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    # Inner products are of vectors of one length; each length is a table with its own index.
    parts = [_search_length(sound.filter(F.size("v") == length) if len(lengths) > 1 else sound, n_rows, kind, k, sample)
             for length, n_rows in sorted(lengths.items())]
    return reduce(DataFrame.unionAll, parts)


def _search_length(sound: DataFrame, n_rows: int, kind: str, k: int, sample: int) -> DataFrame:
    """``search`` over ``sound`` (id, v, asks, row) of ``n_rows`` rows, with vectors of one length."""
    index = fit(sound, n_rows, sample, k)
    placed = stage(_placed(sound, index, kind), "placed")
    sizes = placed.groupBy("part").agg(F.count_if(~F.col("asking")).alias("rows"), F.count_if("asking").alias("queries"))
    counts = {r.part: (-(-r.rows // BLOCK_ROWS), -(-r.queries // QUERY_ROWS)) for r in sizes.collect()}
    table = sound.sparkSession.createDataFrame([(p, max(1, b), max(1, q)) for p, (b, q) in counts.items()],
                                               "part int, blocks bigint, groups bigint")
    # At most one row per part.
    dealt = placed.join(F.broadcast(table), "part")
    own = F.xxhash64("row")
    units = F.when(F.col("asking"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: F.struct(
        b.alias("block"), F.pmod(own, F.col("groups")).alias("group")))).otherwise(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1), lambda g: F.struct(
                F.pmod(own, F.col("blocks")).alias("block"), g.alias("group"))))
    dealt = dealt.select("part", "asking", "row", "id", "v", F.explode(units).alias("unit")).select(
        "part", "unit.*", "asking", "row", "id", "v")

    def nearest(table):
        import numpy as np
        import pyarrow as pa

        asking = table.column("asking").to_numpy(zero_copy_only=False)
        ids, rows_ = table.column("id").to_numpy(), table.column("row").to_numpy()
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids[~asking], kind="stable")
        names, held = ids[~asking][order], vectors[~asking][order]
        found = []
        for at in range(0, int(asking.sum()), 128):
            who, what, row_ = (c[asking][at:at + 128] for c in (ids, vectors, rows_))
            products = what @ held.T
            products[who[:, None] == names[None, :]] = -np.inf
            for of, name, row in zip(row_, who, products, strict=True):
                best = np.argpartition(-row, k)[:k] if len(row) > k else np.arange(len(row))
                if len(row) > k:  # all that tie with the last, then the smaller ids
                    best = np.flatnonzero(row >= row[best].min())
                best = best[row[best] > -np.inf]
                best = best[np.lexsort((names[best], -row[best]))][:k]
                found += [(of, name, names[i], row[i]) for i in best]
        r, q, i, s = zip(*found, strict=True) if found else ((), (), (), ())
        types = table.schema.field("id").type
        return pa.table([pa.array(r, pa.int64()), pa.array(q, types), pa.array(i, types), pa.array(s, pa.float64())],
                        ["row", "query_id", "id", "score"])

    hits = dealt.groupBy("part", "block", "group").applyInArrow(
        nearest, f"row bigint, query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def _placed(sound: DataFrame, index: Index, kind: str) -> DataFrame:
    """(part, asking, row, id, v): each vector once in its part, and each query in all parts it is routed to."""

    def placed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            batch = batch.filter(pa.array(lengths == index.dimensions))
            if not batch.num_rows:
                continue
            vectors = batch.column("v").flatten().to_numpy().reshape(-1, index.dimensions)
            ranked = np.argsort(-index.probabilities(vectors), axis=1, kind="stable")[:, :index.probes]
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            of = np.concatenate([np.arange(len(vectors)), np.repeat(asks, ranked.shape[1])])
            part = np.concatenate([ranked[:, 0], ranked[asks].ravel()]).astype(np.int32)
            taken = batch.select(["row", "id", "v"]).take(pa.array(of))
            asking = np.arange(len(of)) >= len(vectors)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(asking), *taken.columns], ["part", "asking", "row", "id", "v"])

    return in_batches(sound, placed, f"part int, asking boolean, row bigint, id {kind}, v array<double>")
