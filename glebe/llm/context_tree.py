"""Code length of texts by context-tree weighting over bytes, beside a unigram word score.

Each byte is eight binary decisions. A decision has a tree of contexts: the last 0, 1, ... DEPTH bytes before it. Every
node keeps a Krichevsky-Trofimov estimate of its zeros and ones, and weighs it against what its children make of the
same data: P_w = (P_kt + product of the children's P_w) / 2, and P_w = P_kt at full depth. A decision is predicted by
mixing the estimates along its path with the weights that follow from that. The counts are those of the training texts
and stay fixed while texts are scored.

Texts are scored block by block. Each block tells its (DEPTH + 1)-grams of bytes and its words with their training
counts, sorted into buckets: grams by their last two context bytes, words by hash. A bucket sums what all blocks told,
works out its trees, and answers each block for just what that block has. Tables and counts travel packed, so the model
grows with the corpus while no task holds more than a bucket or a block of it; nothing of it is broadcast.
"""

from __future__ import annotations

from math import lgamma, log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.llm.common import in_batches, rows_of, stage, text_or_empty

DEPTH = 5
#: Bytes of text in a block, the unit that is scored by one call.
BLOCK_BYTES = 16 << 20
#: Buckets of grams, and as many of words, at most; they are read as streams, so more blocks only take longer.
MOST_BUCKETS = 4096
#: Grams whose trees are worked out at a time, about; those of one pair of last bytes stay together.
SLOT_GRAMS = 100_000
#: Stands before and after each text; no byte of UTF-8.
_EDGE = 0xFF
_CHUNK = 1 << 20
_BITS = 8


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo the folds. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Staged texts, some to a row: (block, ids, held, sizes, data). ``data`` has the lower-cased bytes of the texts,
    compressed; a null text is empty. Blocks and rows end by bytes."""

    def blocked(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        block, block_size, size, texts, ids, holds, kind = TaskContext.get().partitionId() << 20, 0, 0, [], [], [], None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([holds], pa.list_(pa.bool_())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack(b"".join(texts))], pa.binary())],
                ["block", "ids", "held", "sizes", "data"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for id_, is_held, text in rows_of(batch, "id", "held", "text"):
                texts.append(text.encode().lower())
                ids.append(id_)
                holds.append(is_held)
                size += len(texts[-1]) + 64
                if size > _CHUNK:
                    yield row()
                    block_size += size
                    if block_size > BLOCK_BYTES:
                        block, block_size = block + 1, 0
                    size, texts, ids, holds = 0, [], [], []
        if texts:
            yield row()

    held = held_out(id_col) if held is None else held
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    for field in T.DataType.fromDDL("held array<boolean>, sizes array<bigint>, data binary").fields:
        schema.add(field)
    return stage(in_batches(rows, blocked, schema), "blocks")


def _texts(sizes: list[int], data: bytes) -> list[bytes]:
    from zstandard import ZstdDecompressor

    joined = ZstdDecompressor().decompress(data) if sum(sizes) else b""
    out, at = [], 0
    for size in sizes:
        out.append(joined[at:at + size])
        at += size
    return out


def _pack_ints(numbers) -> bytes:
    """Whole numbers, as their differences, byte plane by byte plane; small and sorted ones shrink well."""
    import numpy as np
    from zstandard import ZstdCompressor

    steps = np.diff(numbers, prepend=0).astype("<i8")
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_ints(packed: bytes):
    import numpy as np
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _pack_words(words: list[bytes]) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(b" ".join(words))


def _unpack_words(packed: bytes) -> list[bytes]:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(packed).split(b" ")


def _summed(parts):
    """Distinct sorted keys and their sums, of pairs of arrays."""
    import numpy as np

    keys, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def block_counts(blocks: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """(bucket, block, keys, n): the grams and the words of each block, with the times its training texts have them, 0
    included, packed. Grams have the buckets below ``buckets``, words those from there on."""

    def counted(batches):
        from collections import Counter, defaultdict
        from zlib import crc32

        import numpy as np
        import pandas as pd
        import pyarrow as pa

        def told(block, words, seen, parts):
            rows = []
            keys, n = _summed(parts)
            of = _pair_hash((keys >> _BITS) & 0xFFFF) % buckets
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(buckets + 1))
            for bucket in np.unique(of).tolist():
                own = order[ends[bucket]:ends[bucket + 1]]
                rows.append((bucket, _pack_ints(keys[own]), _pack_ints(n[own])))
            for word in seen:
                words.setdefault(word, 0)
            lists = defaultdict(list)
            for word in words:
                lists[crc32(word) % buckets].append(word)
            for bucket, own in lists.items():
                own.sort()
                rows.append((buckets + bucket, _pack_words(own), _pack_ints(np.array([words[w] for w in own]))))
            names, keys, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([block] * len(rows), pa.int64()),
                                              pa.array(keys, pa.binary()), pa.array(n, pa.binary())], ["bucket", "block", "keys", "n"])

        of, words, seen, parts = None, Counter(), set(), []
        for batch in batches:
            for block, held, sizes, data in rows_of(batch, "block", "held", "sizes", "data"):
                if block != of and parts:
                    yield from told(of, words, seen, parts)
                    words, seen, parts = Counter(), set(), []
                of, texts = block, _texts(sizes, data)
                for is_held, text in zip(held, texts, strict=True):
                    (seen if is_held else words).update(text.split())
                training = ~np.array(held)
                for first, last, keys, lengths in _gram_chunks(texts, depth):
                    codes, distinct = pd.factorize(keys)
                    weight = np.repeat(training[first:last].astype(np.float64), lengths)
                    parts.append((distinct, np.bincount(codes, weight, len(distinct)).astype(np.int64)))
                if len(parts) > 8:
                    parts = [_summed(parts)]
        if parts:
            yield from told(of, words, seen, parts)

    return in_batches(blocks, counted, "bucket int, block bigint, keys binary, n binary")


def _pair_hash(pairs):
    return (pairs * 2654435761 >> 8) & 0xFFFFFF


def bucket_sums(counts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, n, total, kinds): per bucket its distinct keys and sums over all blocks, packed; and for words
    the sum of all and the number of those that are not 0."""

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        of, parts, words = None, [], {}

        def told():
            if of < buckets:
                keys, n = _summed(parts)
                row = (of, _pack_ints(keys), _pack_ints(n), 0, 0)
            else:
                own = sorted(words)
                n = np.array([words[w] for w in own])
                row = (of, _pack_words(own), _pack_ints(n), int(n.sum()), int((n > 0).sum()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)],
                                              ["bucket", "keys", "n", "total", "kinds"])

        for batch in batches:
            for bucket, keys, n in rows_of(batch, "bucket", "keys", "n"):
                if bucket != of:
                    if of is not None:
                        yield told()
                    of, parts, words = bucket, [], {}
                if of < buckets:
                    parts.append((_unpack_ints(keys), _unpack_ints(n)))
                    if len(parts) > 16:
                        parts = [_summed(parts)]
                else:
                    for word, times in zip(_unpack_words(keys), _unpack_ints(n).tolist(), strict=True):
                        words[word] = words.get(word, 0) + times
        if of is not None:
            yield told()

    dealt = counts.select("bucket", "keys", "n").repartition(_tasks(counts), "bucket").sortWithinPartitions("bucket")
    return stage(in_batches(dealt, summed, "bucket int, keys binary, n binary, total bigint, kinds bigint"), "sums")


def _tasks(df: DataFrame) -> int:
    """A packed table takes more work than its size tells, so its partitions are not to be joined again."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _gram_chunks(data, depth: int):
    """Keys of the grams that end at each byte and at the end of each text, for some texts at a time: (first, last,
    keys, sizes). A key holds the DEPTH bytes before and the byte itself, oldest first."""
    import numpy as np

    first = 0
    while first < len(data):
        last, size = first, 0
        while last < len(data) and (size == 0 or size + len(data[last]) < _CHUNK):
            size += len(data[last]) + depth + 1
            last += 1
        edge = bytes([_EDGE])
        flat = np.frombuffer(b"".join(edge * depth + text + edge for text in data[first:last]), np.uint8).astype(np.int64)
        keys = flat[depth:].copy()
        for back in range(1, depth + 1):
            keys |= flat[depth - back:len(flat) - back] << (_BITS * back)
        sizes = np.array([len(text) + 1 for text in data[first:last]], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
        if len(sizes) > 1:
            keep = np.ones(len(keys), bool)
            for back in range(1, depth + 1):
                keep[starts[1:] - back] = False  # these end within the edge before a text
            keys = keys[keep]
        yield first, last, keys, sizes
        first = last


_SMALL = 64


def log_gamma(x):
    """Natural log of the gamma function for an array of numbers from 1/2 up."""
    import numpy as np

    shifted = np.maximum(x, _SMALL)
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    large = (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * log(2 * pi) + series
    halves = np.array([0.0] + [lgamma(i / 2) for i in range(1, 2 * _SMALL + 1)])
    return np.where(x < _SMALL, halves[(np.minimum(x, _SMALL) * 2).astype(np.int64)], large)


def log_kt(zeros, ones):
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - log(pi)


def _mixed(own, below):
    """Log of P_w from the log of the node's own P_kt and of the product of its children's P_w."""
    import numpy as np

    return np.logaddexp(own, below) - log(2)


def _own_weight(own, weighted):
    import numpy as np

    return np.exp(own - log(2) - weighted)


class Trees:
    """The nodes from full depth up to contexts of two bytes, over the grams of some last two bytes."""

    def __init__(self, grams, counts, depth: int):
        import numpy as np

        bits = np.arange(_BITS)
        byte = grams[:, None] & 0xFF
        self.prefix = ((1 << bits) | (byte >> (_BITS - bits))).ravel()
        self.bit = ((byte >> (_BITS - 1 - bits)) & 1).ravel()
        context = np.repeat(grams >> _BITS, _BITS)
        counts = np.repeat(counts.astype(np.float64), _BITS)
        self.levels = []  # from full depth up: (place of each path's node, its share of P_kt, its estimate of a one)
        nodes = zeros = ones = weighted = None
        for level in range(depth, 1, -1):
            if nodes is None:
                names, place = np.unique((context & ((1 << _BITS * level) - 1)) << _BITS | self.prefix, return_inverse=True)
                ones = np.bincount(place, counts * self.bit, len(names))
                zeros = np.bincount(place, counts * (1 - self.bit), len(names))
                weighted = own = log_kt(zeros, ones)
                share = np.ones(len(names))
            else:
                mask = ((1 << _BITS * level) - 1) << _BITS | 0xFF
                names, up = np.unique(nodes & mask, return_inverse=True)
                zeros, ones, below = (np.bincount(up, v, len(names)) for v in (zeros, ones, weighted))
                own = log_kt(zeros, ones)
                weighted = _mixed(own, below)
                share = _own_weight(own, weighted)
                place = up[place]
            nodes = names
            self.levels.append((place, share, (ones + 0.5) / (zeros + ones + 1.0)))
        self.tops, self.zeros, self.ones, self.weighted = nodes, zeros, ones, weighted

    def ones_predicted(self):
        """Per path, what the nodes here predict for a one."""
        predicted = 0.0
        for place, share, estimate in self.levels:
            predicted = share[place] * estimate[place] + (1 - share[place]) * predicted
        return predicted


def _slices(keys):
    """Places of keys whose trees are worked out together: all of some pairs of last context bytes."""
    import numpy as np

    pair = (keys >> _BITS) & 0xFFFF
    order = np.argsort(pair, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0]))
    first = 0
    for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
        if end - first >= SLOT_GRAMS or end == len(keys):
            yield order[first:end]
            first = end


def top_nodes(sums: DataFrame, depth: int = DEPTH) -> list:
    """The zeros and ones of each node with a context of one byte, and the log of its children's P_w: at most 256 * 255
    rows, whatever the corpus."""

    def tops(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, n in rows_of(batch, "keys", "n"):
                keys, n = _unpack_ints(keys), _unpack_ints(n)
                keys, n = keys[n > 0], n[n > 0]
                for own in _slices(keys) if len(keys) else ():
                    trees = Trees(keys[own], n[own], depth)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (trees.tops, trees.zeros, trees.ones, trees.weighted)],
                                                     ["node", "zeros", "ones", "weighted"])

    pairs = in_batches(sums, tops, "node bigint, zeros double, ones double, weighted double")
    return pairs.groupBy(F.col("node").bitwiseAND(F.lit(0xFFFF)).alias("node")).agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")).orderBy("node").collect()


def gram_scores(keys, counts, upper, depth: int = DEPTH):
    """log10 of the probability of each gram's last byte after the bytes before it.

    ``keys`` are all grams of some pairs of last context bytes; those with count 0 only ask. ``upper`` is what
    ``_upper`` makes of the nodes above.
    """
    import numpy as np

    out = np.empty(len(keys))
    share, estimate, root_share, root_estimate = upper
    for own in _slices(keys):
        trees = Trees(keys[own], counts[own], depth)
        node = np.repeat((keys[own] >> _BITS) & 0xFF, _BITS) << _BITS | trees.prefix
        predicted = share[node] * estimate[node] + (1 - share[node]) * trees.ones_predicted()
        predicted = root_share[trees.prefix] * root_estimate[trees.prefix] + (1 - root_share[trees.prefix]) * predicted
        chances = np.where(trees.bit == 1, predicted, 1 - predicted)
        out[own] = np.log10(chances).reshape(-1, _BITS).sum(axis=1)
    return out


def block_answers(counts: DataFrame, sums: DataFrame, upper, buckets: int, depth: int = DEPTH) -> DataFrame:
    """(block, bucket, keys, figures): for the keys a block told, the scores of grams and the counts of words."""

    def answered(batches):
        import numpy as np
        import pyarrow as pa

        keys = figures = words = None
        for batch in batches:
            out = []
            for bucket, block, told, n in rows_of(batch, "bucket", "block", "keys", "n"):
                if block is None:  # the bucket's own row comes first
                    if bucket < buckets:
                        keys = _unpack_ints(told)
                        figures = gram_scores(keys, _unpack_ints(n), upper, depth)
                    else:
                        words = dict(zip(_unpack_words(told), _unpack_ints(n).tolist(), strict=True))
                elif bucket < buckets:
                    own = figures[np.searchsorted(keys, _unpack_ints(told))]
                    out.append((block, bucket, told, own.astype("<f8").tobytes()))
                else:
                    out.append((block, bucket, told, _pack_ints(np.array([words[w] for w in _unpack_words(told)]))))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["block", "bucket", "keys", "figures"])

    own = sums.select("bucket", F.lit(None).cast("bigint").alias("block"), "keys", "n")
    asked = counts.select("bucket", "block", "keys", F.lit(None).cast("binary").alias("n"))
    dealt = own.union(asked).repartition(_tasks(counts), "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    return in_batches(dealt, answered, "block bigint, bucket int, keys binary, figures binary")


def _upper(singles):
    """Shares of P_kt and estimates of a one at contexts of one byte and of none."""
    import numpy as np

    size = 1 << (2 * _BITS)
    zeros, ones, below = (np.zeros(size) for _ in range(3))
    for r in singles:
        zeros[r.node], ones[r.node], below[r.node] = r.zeros, r.ones, r.below
    own = log_kt(zeros, ones)
    weighted = _mixed(own, below)
    share, estimate = _own_weight(own, weighted), (ones + 0.5) / (zeros + ones + 1.0)
    zeros, ones, below = (v.reshape(-1, 1 << _BITS).sum(axis=0) for v in (zeros, ones, weighted))
    own = log_kt(zeros, ones)
    return share, estimate, _own_weight(own, _mixed(own, below)), (ones + 0.5) / (zeros + ones + 1.0)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None,
                depth: int = DEPTH) -> DataFrame:
    """(id, held, n_bytes, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``score`` is the log10 probability of the text's bytes and its end, A-Z lower-cased; bits per byte follow from
    it. ``base_score`` is that of its words and its end by add-one word frequencies of the training texts, all three
    counts over words and one end per text. A null text is empty; repeated rows are scored and counted each.
    """
    blocks = blocks_of(docs, id_col, text_col, held)
    seen = blocks.agg(F.count_distinct("block").alias("blocks"),
                      F.sum(F.size(F.filter("held", lambda h: ~h))).alias("texts")).first()
    buckets, texts = min(MOST_BUCKETS, max(8, 2 * seen.blocks)), seen.texts or 0
    counts = stage(block_counts(blocks, buckets, depth), "block-counts")
    sums = bucket_sums(counts, buckets)
    totals = sums.agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    train, kinds = (totals.n or 0) + texts, (totals.v or 0) + (texts > 0)
    upper = _upper(top_nodes(sums.filter(F.col("bucket") < buckets), depth))
    answers = block_answers(counts, sums, upper, buckets, depth)

    def scored(rows, model):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        count: dict[bytes, int] = {}
        keys, values = [np.empty(0, np.int64)], [np.empty(0)]
        for bucket, told, figures in zip(*(model.column(c).to_pylist() for c in ("bucket", "keys", "figures")), strict=True):
            if bucket < buckets:
                keys.append(_unpack_ints(told))
                values.append(np.frombuffer(figures, "<f8"))
            else:
                count.update(zip(_unpack_words(told), _unpack_ints(figures).tolist(), strict=True))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        out: list[list] = [[] for _ in range(7)]
        for ids, is_held, sizes, data in zip(*(rows.column(c).to_pylist() for c in ("ids", "held", "sizes", "data")), strict=True):
            data = _texts(sizes, data)
            for text in data:
                found = text.split()
                c = np.fromiter(map(count.__getitem__, found), np.int64, len(found))
                out[3].append(len(c) + 1)
                out[4].append(int((c > 0).sum()) + (texts > 0))
                out[5].append(float(np.log10(c + 1.0).sum() + np.log10(texts + 1.0) - (len(c) + 1) * np.log10(train + kinds + 1.0)))
            for _, _, grams, lengths in _gram_chunks(data, depth):
                codes, distinct = pd.factorize(grams)
                each = values[np.searchsorted(keys, distinct)][codes]
                out[6] += np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]])).tolist()
            out[0] += ids
            out[1] += is_held
            out[2] += sizes
        types = [rows.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["id", "held", "n_bytes", "n_tokens", "n_known", "base_score", "score"]
        table = pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)
        return table.add_column(5, "train_tokens", pa.array([train] * len(out[0]), pa.int64()))

    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("held", T.BooleanType())])
    for field in T.DataType.fromDDL("n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                    "base_score double, score double").fields:
        schema.add(field)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
