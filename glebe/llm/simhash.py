"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Two fingerprints within the radius agree on some blocks of their bits, so each fingerprint goes to the shards named
by its block values, and a link can only lie within a shard. Each shard is a BK-tree: children are keyed by their
integer Hamming distance to the parent, and a search follows only edges within the radius of its own distance.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glebe.llm.common import in_batches, stage, text_or_empty, whole_row
from glebe.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints in one tree; a shard with more is several trees, each searched by every part of the shard.
TREE_SIZE = 8192
_BITS = 64


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(id, fp): a bit of fp is set if it is set in over half of the XXH64 values of the shingles, repeats included.

    A-Z is lower-cased; words end at ASCII white space; a text with fewer words is one shingle; without words, and
    for a null text, fp is 0.
    """

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def values(text):
            words = text.encode().lower().split()
            if len(words) >= shingle:
                return [xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)),
                                                                              strict=False))]
            return [xxh64_intdigest(b" ".join(words), seed)] if words else []

        def majority(lists):
            out = np.zeros(len(lists), np.uint64)
            full = [i for i, v in enumerate(lists) if v]
            if full:
                sizes = np.array([len(lists[i]) for i in full])
                flat = np.fromiter((h for v in lists for h in v), np.uint64, int(sizes.sum()))
                bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.uint32)
                over = np.packbits(2 * ones.astype(np.int64) > sizes[:, None], axis=1, bitorder="little")
                out[full] = np.ascontiguousarray(over).view("<u8")[:, 0]
            return out.view(np.int64)

        for batch in batches:
            parts, lists, size = [], [], 0
            for text in batch.column("text").to_pylist():
                lists.append(values(text))
                size += len(lists[-1])
                if size > 200_000:
                    parts.append(majority(lists))
                    lists, size = [], 0
            parts.append(majority(lists))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(parts))], ["id", "fp"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    kind = "string" if kind == "void" else kind
    keyed = docs.select(F.col(id_col).cast(kind).alias("id"), text_or_empty(text_col).alias("text"))
    return in_batches(keyed, hashed, f"id {kind}, fp bigint")


def links(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints of ``prints`` (fp) within the radius.

    Within a tree only links that join parts not yet joined are told, so a dense group yields a chain, not all its
    pairs; the components are those of all links.
    """
    shards = _sharded(prints, radius)
    crowded = shards.groupBy("shard").count().filter(F.col("count") > tree_size).select(
        "shard", F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    placed = shards.join(crowded, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    units = placed.select("shard", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asks"),
                          (F.col("own") > F.col("other")).alias("asking"), "fp")
    dealt = units.repartition("shard", "tree", "asks").sortWithinPartitions("shard", "tree", "asks", "asking", "fp")

    def linked(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []

        def told(columns, ends):
            out = []
            for start, end in ends:
                out += tree_links(columns[4][start:end].tolist(), columns[3][start:end].tolist(),
                                  bool(columns[1][start] == columns[2][start]), radius)
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def runs(columns):
            keys = np.stack([c.astype(np.int64) for c in columns[:3]])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            return starts, np.concatenate([starts[1:], [len(columns[0])]])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)] if held else columns
            starts, ends = runs(columns)
            # The last run may go on in the next batch.
            yield told(columns, [(s, e) for s, e in zip(starts[:-1], ends[:-1], strict=True) if e - s > 1])
            held = [c[starts[-1]:] for c in columns]
        if held and len(held[0]) > 1:
            yield told(held, [(0, len(held[0]))])

    return in_batches(dealt, linked, "a bigint, b bigint").distinct()


def tree_links(prints: list[int], asking: list[bool], alone: bool, radius: int) -> list[tuple[int, int]]:
    """Links found with one BK-tree. ``asking`` marks fingerprints that only search; if ``alone``, all also search."""
    root: list | None = None
    parent: dict[int, int] = {}
    out = []

    def top(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for value, asks in zip(prints, asking, strict=True):
        if root is None:
            if not asks:
                root = [value, {}]
            continue
        if asks or alone:
            stack = [root]
            while stack:
                node, children = stack.pop()
                distance = ((node ^ value) & 0xFFFFFFFFFFFFFFFF).bit_count()
                if distance <= radius and top(node) != top(value):
                    parent[top(node)] = top(value)
                    out.append((node, value))
                if len(children) > 2 * radius + 1:
                    for edge in range(distance - radius, distance + radius + 1):
                        if edge in children:
                            stack.append(children[edge])
                else:
                    stack += [child for edge, child in children.items() if abs(edge - distance) <= radius]
        if not asks:
            node = root
            while (distance := ((node[0] ^ value) & 0xFFFFFFFFFFFFFFFF).bit_count()) in node[1]:
                node = node[1][distance]
            if distance:
                node[1][distance] = [value, {}]
    return out


def _sharded(prints: DataFrame, radius: int) -> DataFrame:
    """(shard, fp): of radius + 2 blocks of bits, any two fingerprints within the radius share two blocks."""
    blocks = radius + 2
    bounds = [_BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << high) - 1) & ~((1 << low) - 1) for low, high in zip(bounds, bounds[1:], strict=False)]
    signed = [m - (1 << _BITS) if m >= 1 << (_BITS - 1) else m for m in masks]
    shards = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x).cast("bigint")),
                         F.col("fp").bitwiseAND(F.lit(y).cast("bigint")))
              for i, (x, y) in enumerate(combinations(signed, 2))]
    return prints.select("fp", F.explode(F.array(*shards)).alias("shard"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                          radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): per row its fingerprint and the least id reachable over links, its own included.

    Equal texts share a fingerprint, so only distinct fingerprints are linked; all copies keep a row. Null ids take
    part and never are the least, unless a whole group has none.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(stage(links(classes.select("fp"), radius), "links"))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_class = rooted.join(least, "root").select("fp", "component")
    return prints.join(of_class, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The rows without near-duplicates: of each group the row with the least id stays, exactly one.

    Null ids come last; among rows with one id the first of the staged table stays. Columns are those of the input.
    """
    rows = stage(docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs")
    key = F.struct(F.col(f"doc.{id_col}").isNull().alias("none"), F.col(f"doc.{id_col}").alias("id"), "row")
    keyed = rows.select(key.alias("key"), F.col(f"doc.{text_col}").alias("text"))
    groups = near_duplicate_groups(keyed, "key", "text", shingle, radius)
    kept = groups.filter(F.col("id") == F.col("component")).select(F.col("id.row").alias("row"))
    return rows.join(kept, "row").select("doc.*")
