import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glebe.llm import exact_search as es


def plainly(rows, picks, k=10):
    """All pairs, one by one: {(query_id, place among rows of that id): hits}."""
    sound = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, q in sound:
        if picks(i):
            hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in sound if j != i and len(v) == len(q))
            out[i, tuple((rank, j, -s) for rank, (s, j) in enumerate(hits[:k], 1))] += 1
    return out


def found(df, picks, **options):
    """The hits a query id has, rank by rank; queries of one id have their hits side by side."""
    out = {}
    for r in es.search(df, picks, **options).collect():
        out.setdefault(r.query_id, Counter())[r.rank, r.id, r.score] += 1
    return out


def side_by_side(plain):
    out = {}
    for (i, hits), n in plain.items():
        for hit in hits:
            out.setdefault(i, Counter())[hit] += n
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", None) for i, v in rows], "vec_id bigint, embedding array<float>, row string, block int").repartition(3)


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(12) / 3).tolist()) for i in range(3000)]
    rows += [(5000 + i, (rng.integers(-2, 3, 12) / 8).tolist()) for i in range(500)]
    assert found(frame(spark, rows), F.col("vec_id") % 100 == 0) == side_by_side(plainly(rows, lambda i: i % 100 == 0))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []),
            (100, []), (6, [0.0, 0.0]), (200, [0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (300, [0.5, 0.25, -1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]),
            (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [-0.0003, 0.0009])] + [(11, [0.5, 0.5])] * 40
    assert found(frame(spark, rows), F.col("vec_id") % 100 == 0) == side_by_side(plainly(rows, lambda i: i % 100 == 0))
    few = [(i, v) for i, v in rows[:3]]
    assert found(frame(spark, few), F.col("vec_id") == 0) == {}
    empty = es.search(frame(spark, rows).limit(0), F.lit(True))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "id", "score"]


def test_names_as_ids_and_null_picks(spark):
    rows = [(f"n{i}", [float(i % 5), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = es.search(df, F.when(F.col("vec_id") == "n7", True), k=3).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [("n7", "n104"), ("n7", "n109"), ("n7", "n114")]


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [3e13]), (1, [3e13])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        es.search(df, F.lit(True)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 9), st.integers(1, 6), st.sampled_from([1, 5, 10**3, 10**12]))
def test_bounds_lose_nothing(seed, n, length, k, width):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-width, width + 1, (n, length)) * rng.integers(0, 2, length)
    ids = rng.permutation(n + 5)[:n].tolist()
    query = rng.integers(-width, width + 1, length) if width < 10**12 else rng.integers(-5, 6, length)
    own = ids[0]
    plain = sorted((-sum(a * b for a, b in zip(map(int, query), map(int, v), strict=True)), i) for i, v in zip(ids, vectors, strict=True) if i != own)
    block = es.Block(ids, vectors, np.ones(n, np.int64))
    assert [(-s, i) for i, s, _ in block.best(query, own, k)] == plain[:k]


def test_reading_stops_early_where_a_list_decides(monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (2000, 6))
    vectors[:, 2] = rng.permutation(2000) - 1000
    segment = es.Segment(list(range(2000)), vectors, np.ones(2000, np.int64))
    query, depths, sums = np.array([1, -1, 50, 0, 1, 1]), [], segment._sums
    segment._sums = lambda rows, products, others: depths.append(rows.shape[1]) or sums(rows, products, others)
    left = segment.candidates(query, -1, 10)
    assert len(left) <= 160 and max(depths) <= 1250
    best = sorted(left, key=lambda hit: (-hit[1], hit[0]))[:10]
    depths.clear()
    # Ten scores from elsewhere spare reading further.
    assert set(best) <= set(segment.candidates(query, -1, 10, best[-1][1])) and max(depths) <= 500


def test_segments_give_what_one_does(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (700, 5))
    ids = rng.permutation(700).tolist()
    whole = es.Block(ids, vectors, np.ones(700, np.int64))
    monkeypatch.setattr(es, "SEGMENT", 60)
    parts = es.Block(ids, vectors, np.ones(700, np.int64))
    assert len(parts.segments) == 12
    for q in rng.integers(-2, 3, (20, 5)):
        assert whole.best(q, 5, 7) == parts.best(q, 5, 7)
