import numpy as np
import pytest
from pyspark.sql import functions as F

from glebe.llm import partition_search as ps


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 0, "s") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, part string").repartition(4)


def exact(vectors, ids, query, k):
    x = np.array(vectors, np.float32).astype(np.float64)
    scores = x @ x[query]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]][:k]
    return [(ids[i], scores[i]) for i in order]


def found(frame, picks, **options):
    out = {}
    for r in ps.search(frame, picks, **options).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    return {q: [(i, s) for _, i, s in sorted(hits)] for q, hits in out.items()}


def clustered(n, size, seed, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, size))
    return middle[rng.integers(0, centres, n)] + 0.6 * rng.standard_normal((n, size))


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ps, "ROOT_SHARE", 4)
    monkeypatch.setattr(ps, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ps, "QUERY_ROWS", 16)
    vectors = clustered(3000, 24, 1)
    got = found(table(spark, vectors), F.col("vec_id") % 20 == 0, sample=1200)
    assert len(got) == 150
    hits = 0
    for q, rows in got.items():
        wanted = exact(vectors, np.arange(3000), q, 20)
        assert len(rows) == 20 and q not in [i for i, _ in rows]
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        truth = np.array(vectors, np.float32).astype(np.float64)
        assert all(s == pytest.approx(truth[i] @ truth[q], abs=1e-12) for i, s in rows)
        hits += len({i for i, _ in rows} & {i for i, _ in wanted})
    assert hits / (150 * 20) >= 0.95


def test_parts_are_balanced_and_probed(spark, monkeypatch):
    monkeypatch.setattr(ps, "ROOT_SHARE", 2)
    vectors = clustered(2000, 16, 3)
    near = ps._graph(vectors, 16)
    of = ps._balanced_parts(near, 10)
    sizes = np.bincount(of, minlength=10)
    assert sizes.min() >= 190 and sizes.max() <= 210
    cut = (of[near] != of[:, None]).mean()
    assert cut < 0.45  # nine tenths of random parts' edges would be cut
    frame = table(spark, vectors).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    index = ps.fit(frame, 2000, 2000)
    assert index.parts > 10 and 1 < index.probes < index.parts


def test_ties_copies_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ps, "BLOCK_ROWS", 50)
    vectors = [[1.0, 0.0]] * 300 + [[0.0, 1.0]] * 5 + [[0.5, 0.5]]
    got = found(table(spark, vectors), F.col("vec_id").isin(0, 7, 302, 305))
    assert [i for i, _ in got[0]] == list(range(1, 21))
    assert [i for i, _ in got[7]] == [*range(7), *range(8, 21)]
    assert [i for i, _ in got[302]][:4] == [300, 301, 303, 304]
    assert [i for i, _ in got[305]] == list(range(20))


def test_unusable_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [3.0, 1.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [-1.0, 0.0]]
    got = found(table(spark, vectors), F.lit(True))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {0: [1, 8], 1: [0, 8], 8: [0, 1]}
    assert ps.search(table(spark, vectors).limit(0), F.lit(True)).count() == 0
    assert ps.search(table(spark, [None, [0.0]]), F.lit(True)).count() == 0
    assert ps.search(table(spark, vectors), F.lit(None).cast("boolean")).count() == 0


def test_repeated_ids_and_large_components(spark):
    vectors = [[1e30, 1.0], [1e-30, 2e-30], [1.0, 1.0], [1.0, 1.0]]
    got = found(table(spark, vectors, ids=[1, 2, 3, 3]), F.col("vec_id") == 3)
    assert [i for i, _ in got[3]] == [1, 1, 2, 2]
    got = found(table(spark, vectors, ids=[1, 2, 3, 3]), F.col("vec_id") == 2)
    assert [i for i, _ in got[2]] == [1, 3, 3]


def test_many_copies_of_few_vectors(spark):
    few = np.random.default_rng(4).standard_normal((3, 6)).tolist()
    got = found(table(spark, few * 700), F.col("vec_id") < 3, sample=2)
    assert sorted(got) == [0, 1, 2] and all(len(rows) == 20 for rows in got.values())


def test_vectors_of_two_lengths(spark):
    vectors = [[1.0, 2.0], [1.0, 2.0, 3.0], [3.0, 1.0], [0.5, 1.0, 1.0], [2.0, 2.0]]
    got = found(table(spark, vectors), F.lit(True))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {0: [4, 2], 1: [3], 2: [4, 0], 3: [1], 4: [2, 0]}


def test_probes_are_chosen_on_held_out_points(spark, monkeypatch):
    monkeypatch.setattr(ps, "ROOT_SHARE", 2)
    assert ps.WANTED >= 0.98
    seen = []
    trained = ps._classifier
    monkeypatch.setattr(ps, "_classifier", lambda inputs, *rest: seen.append(inputs) or trained(inputs, *rest))
    vectors = clustered(2000, 16, 3)
    index = ps.fit(table(spark, vectors).select(F.col("embedding").cast("array<double>").alias("v")), 2000, 2000)
    assert len(seen[0]) == 1750  # one in eight is left to choose the probes by
    truth = np.array(vectors, np.float32).astype(np.float64)
    products = truth @ truth.T
    np.fill_diagonal(products, -np.inf)
    near = np.argsort(-products, axis=1)[:, :20]
    odds = index.probabilities(truth)
    rank = np.argsort(np.argsort(-odds, axis=1), axis=1)
    assert (np.take_along_axis(rank, odds.argmax(axis=1)[near], axis=1) < index.probes).mean() >= 0.97
