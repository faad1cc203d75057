import hashlib
import math
import re
import zlib

from llm_texts import prose

from glebe.llm import resampling as rs


def grams(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plainly(docs, target, percent=5, min_words=20, buckets=10_000):
    """Sorted (doc_id, n_features, weight, score, rank), computed one by one."""

    def counts(texts):
        out = {}
        for t in texts:
            for g in grams(t)[1]:
                b = zlib.crc32(g.encode()) % buckets
                out[b] = out.get(b, 0) + 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (big_s + buckets) / ((s.get(b, 0) + 1.0) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(docs, target, **options):
    out = rs.resample(docs, target, **options).select("doc.doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=repr)


def texts(rows):
    return [(r.doc_id, r.text) for r in rows.collect()]


def test_odd_documents(spark, odd_docs, no_docs):
    aims = ["the of and to", None, "", "Größe λόγος, and THE of that!", prose(5, 200)]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(aims)], "item_id bigint, text string, features string")
    for percent in (0, 5, 50, 100):
        assert found(odd_docs, target, percent=percent) == plainly(texts(odd_docs), aims, percent)
    assert found(no_docs, target) == []
    assert found(odd_docs, target.limit(0), percent=50) == plainly(texts(odd_docs), [], 50)


def test_ranks_run_over_partitions(spark):
    docs = [(i, prose(i % 40, 10 + i % 60)) for i in range(2000)] + [(7, prose(7, 40))] * 30
    target = [prose(i, 30) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = found(df, aim, percent=30)
    assert got == plainly(docs, target, 30)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + len([r for r in got if r[4]])))


def test_separators_and_few_words(spark):
    docs = [(1, "One-two\x00three__FOUR"), (2, " a "), (3, "a\n\nb"), (4, "...!"), (5, "É é x z9"), (6, "x" * 200_000 + " y")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(df, df.select("text"), min_words=1, percent=100) == plainly(docs, [t for _, t in docs], 100, 1)


def test_matches_in_many_parts(spark):
    docs = [(1, prose(1, 3 * rs._MATCHES + 1)), (2, prose(2, rs._MATCHES)), (3, prose(3, rs._MATCHES + 1))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(df, df.select("text")) == plainly(docs, [t for _, t in docs])


def test_other_bucket_numbers(spark):
    docs = [(i, prose(i, 60)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for buckets in (1, 97, 100_003):
        assert found(df, df.select("text"), buckets=buckets) == plainly(docs, [t for _, t in docs], buckets=buckets)


def test_drawn_documents_are_like_the_target(spark, odd_docs):
    docs = [(i, ("plough field harvest " if i % 4 == 0 else "engine gear wheel ") * 10 + prose(i, 40), "keep", None) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, rank string, weight int")
    aim = spark.createDataFrame([("field harvest plough field",)], "text string")
    out = rs.drawn(df, aim, percent=10).collect()
    assert len(out) == 40 and out[0].asDict().keys() == {"doc_id", "text", "rank", "weight"}
    assert sum(r.doc_id % 4 == 0 for r in out) >= 38
    carried = rs.resample(odd_docs, odd_docs, carry=["n_words", "mark"]).first()
    assert set(carried.doc.asDict()) == {"doc_id", "n_words", "mark"}
