"""Documents resampled towards a target distribution of hashed n-grams.

The n-grams of a text are found by one overlapped regular expression: separators are collapsed to single spaces, and a
match starts at each word, with groups for its one, two and three words, whose bytes go straight into a CRC. The weight of
a document is the sum, over its n-grams, of the log ratio of target and corpus in the n-gram's bucket; a Gumbel number
hashed from the id is added, and the highest scores are drawn, which is sampling without replacement by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.llm.common import in_batches, stage

BUCKETS = 10_000
#: A document with fewer words is never drawn.
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Matches whose n-grams are in memory at a time.
_MATCHES = 20_000

#: One word and up to two more after it, at each place where a word starts.
_GRAMS = rb"(?<![^ ])(([^ ]++)(?: [^ ]++)?+)(?: [^ ]++)?+"


def _plain_bytes() -> bytes:
    """What each byte turns into: letters lower-case, digits and bytes beyond ASCII as they are, all else a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                 for b in range(256))


def hashed_features(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
                    buckets: int = BUCKETS) -> DataFrame:
    """Each row as ``doc`` (its columns in ``carry``, all by default) with ``n_words``, ``n_features`` and ``features``.

    Words are runs of digits, letters and code points beyond ASCII, A-Z in lower case. Features are all runs of one to
    three words; ``features`` holds the bucket of each as unsigned little-endian numbers of four bytes, or of two if
    these suffice. A null, empty or wordless text has none; repeated rows are rows each.
    """
    kept = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    small = buckets <= 1 << 16

    def scan(batches):
        from itertools import islice
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        import regex

        table, pattern = _plain_bytes(), regex.compile(_GRAMS)

        def features(text):
            raw = np.frombuffer(b" " + (text or b"").translate(table), np.uint8)
            # A separator stays if a word follows it; the leading one is cut off.
            flat = raw[np.append((raw[1:] != 0x20) | (raw[:-1] != 0x20), raw[-1] != 0x20)].tobytes().strip()
            matches, parts, last = pattern.finditer(flat, overlapped=True), [], []
            while some := list(islice(matches, _MATCHES)):
                last = (last + some)[-2:]
                parts.append(np.array([crc32(gram) for m in some for gram in m.group(2, 1, 0)], np.uint32) % buckets)
            found = np.concatenate(parts).reshape(-1, 3) if parts else np.zeros((0, 3), np.uint32)
            # At the last word no longer run starts, at the one before no run of three.
            real = np.ones(found.shape, bool)
            real[-1:, 1:] = False
            real[-2:, 2] = False
            return len(found), found[real]

        for batch in batches:
            counted = [features(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([n for n, _ in counted], pa.int64()),
                 pa.array([len(f) for _, f in counted], pa.int64()),
                 pa.array([f.astype("<u2" if small else "<u4").tobytes() for _, f in counted], pa.binary())],
                ["doc", "n_words", "n_features", "features"])

    schema = T.StructType([rows.schema["doc"]]).add("n_words", "long").add("n_features", "long").add("features", "binary")
    return in_batches(rows, scan, schema)


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket that occurs does, counted per task and then added up."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for features in batch.column("features").to_pylist():
                counts += np.bincount(np.frombuffer(features, kind), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    partial = in_batches(featured.select("features"), count, "bucket int, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): the smoothed log ratio of target and corpus in thousandths, floored, for every bucket."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    sums = [F.coalesce(df.agg(F.sum("n")).scalar(), F.lit(0)).cast("double") for df in (corpus, target)]
    ratio = (t + 1) * (sums[0] + buckets) / ((s + 1) * (sums[1] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(featured: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``weight``, the sum of their features' gains, in place of the features.

    The gains, one number a bucket, go to every task.
    """
    import numpy as np

    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # as many rows as buckets
        table[r.bucket] = r.gain

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            sums = [int(table[np.frombuffer(f, kind)].sum()) for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "n_words", "n_features")), pa.array(sums, pa.int64())],
                                             ["doc", "n_words", "n_features", "weight"])

    kept = T.StructType([f for f in featured.schema.fields if f.name != "features"])
    return in_batches(featured, add, kept.add("weight", "long"))


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, floored, hashed from seed and id; all null ids share one."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             carry: list[str] | None = None, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS) -> DataFrame:
    """Each row as ``doc`` (its id and the columns in ``carry``) with ``n_words``, ``n_features``, ``weight``, ``score``
    and ``rank``.

    Of the rows with at least ``min_words`` words, the given percentage, floored, is drawn: highest scores first, ties to
    the smaller id, null ids first of all; rank counts from 1 and is null for the rest. Repeated rows have one score and
    a rank each. An empty target or corpus counts nothing, so all gains come from the smoothing alone.
    """
    kept = list(dict.fromkeys([id_col, *(carry or [])]))
    featured = stage(hashed_features(docs, text_col, kept, buckets), "features")
    wanted = hashed_features(target, text_col, [], buckets)
    gain = gains(stage(bucket_counts(featured, buckets), "corpus"), stage(bucket_counts(wanted, buckets), "target"), buckets)
    name = F.col(f"doc.`{id_col}`")
    scored = weigh(featured, gain, buckets).withColumn("score", F.col("weight") + gumbel(name, seed))
    eligible = F.col("n_words") >= min_words
    # In order over the partitions and within each, so that a place is the rows of the partitions before and its own.
    order = [F.when(eligible, 0).otherwise(1), F.desc("score"), name.asc()]
    placed = stage(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(eligible).alias("able")).orderBy("part").collect()
    before, able = [], 0
    for r in sizes:  # a row a partition
        before.append((r.part, able))
        able += r.able
    starts = docs.sparkSession.createDataFrame(before, "part bigint, before bigint")
    rank = F.col("before") + within + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "doc", "n_words", "n_features", "weight", "score", F.when(eligible & (rank <= able * percent // 100), rank).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with the columns of the input; documents that share an id are drawn together."""
    ranked = resample(docs, target, id_col, **options)
    ids = ranked.filter("rank is not null").select(F.col(f"doc.`{id_col}`").alias("drawn_id")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("drawn_id")), "left_semi")
