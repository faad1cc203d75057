import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glebe.llm import mixing, token_lengths


def draw(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    p = upto = math.exp(-rate)
    n = 0
    while upto <= u and n < 500:
        n += 1
        p *= rate / n
        upto += p
    return n


@pytest.mark.parametrize("rate", [0.0, 0.1, 1.0, 7.5, 60.0])
def test_counts_invert_the_distribution(spark, rate):
    draws = [i / 997 for i in range(997)]
    frame = spark.createDataFrame([(u,) for u in draws], "u double").repartition(1)
    got = {r.u: r.n for r in frame.select("u", mixing.poisson_count(F.lit(rate), F.col("u")).alias("n")).collect()}
    assert got == {u: poisson(rate, u) for u in draws}
    assert abs(sum(got.values()) / len(draws) - rate) < 0.05 * rate + 0.02


def exact_poisson(rate, u):
    """By the logarithm of each probability, from far below the rate on."""
    n = max(0, int(rate - 20 * math.sqrt(rate)) - 20)
    upto = math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
    while upto <= u:
        n += 1
        upto += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
    return n


@pytest.mark.parametrize("rate", [99.5, 150.0, 260.0, 320.5, 1000.0, 40_000.0])
def test_large_rates_are_poisson_too(spark, rate):
    draws = [(i + 0.5) / 499 for i in range(499)] + [1e-7, 1 - 1e-7]
    frame = spark.createDataFrame([(u,) for u in draws], "u double").repartition(1)
    got = {r.u: r.n for r in frame.select("u", mixing.poisson_count(F.lit(rate), F.col("u")).alias("n")).collect()}
    assert got == {u: exact_poisson(rate, u) for u in draws}


def test_variance_is_the_rate(spark):
    row = spark.range(20_000).select(mixing.poisson_count(F.lit(1000.0), mixing.uniform(1, F.col("id"))).alias("n")).agg(
        F.avg("n").alias("mean"), F.variance("n").alias("variance")).first()
    assert abs(row.mean - 1000) < 1 and abs(row.variance - 1000) < 50


def test_mixture_matches_brute_force(spark):
    docs = [(i, "hot" if i % 3 else f"s{i % 5}", f"text {i}") for i in range(900)] + [(1000, None, "t"), (1001, None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(5)
    sizes = Counter(s for _, s, _ in docs)
    whole = sum(n**0.5 for n in sizes.values())
    wanted = Counter()
    for i, s, _ in docs:
        rate = sizes[s] ** 0.5 / whole * len(docs) / sizes[s]
        if n := poisson(rate, draw(17, i)):
            wanted[(i, s)] = n
    rows = mixing.mix(frame).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == wanted
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted((i, c) for (i, _), n in wanted.items() for c in range(n))
    # Given weights, and a source without one.
    rows = mixing.mix(frame, weights={"hot": 1.0, "s0": 3.0}, total=4000).collect()
    got = Counter(r.source for r in rows)
    assert set(got) == {"hot", "s0"} and 0.9 < got["s0"] / 3000 < 1.1 and 0.9 < got["hot"] / 1000 < 1.1
    assert mixing.mix(frame, weights={}).count() == 0


def test_a_repeated_row_is_spread_over_partitions(spark):
    frame = spark.createDataFrame([(1, "a")] * 400, "doc_id int, source string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.mix(frame, total=1200.0).withColumn("p", F.spark_partition_id())
        assert len({r.p for r in mixed.collect()}) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_and_no_documents(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, copy_col=None)
    assert mixed.columns == odd_docs.columns
    assert mixing.mix(odd_docs).columns == [*(c for c in odd_docs.columns if c != "copy"), "copy"]
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert mixing.mix(no_docs).count() == 0


def test_suffix_sums_of_odd_documents(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    lengths = [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.collect()]
    sums = token_lengths.suffix_sums(token_lengths.histogram(token_lengths.encoded_lengths(odd_docs)))
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        longer = [n for n in lengths if n > limit]
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lengths.count(limit), len(longer), sum(longer))
        assert (r.docs_within, r.tokens_within) == (len(lengths) - len(longer), sum(lengths) - sum(longer))
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert r.quantile == (len(lengths) - len(longer)) / len(lengths)
    limits = [0, 1, 37, 4096, 10**6]
    got = {r.limit: r.truncated_tokens for r in token_lengths.truncated_totals(sums, limits).collect()}
    assert got == {x: sum(min(n, x) for n in lengths) for x in limits}
    middle = sorted(lengths)[math.ceil(0.5 * len(lengths)) - 1]
    assert token_lengths.quantile_length(sums, 0.5).first().length == middle
    assert token_lengths.suffix_sums(token_lengths.histogram(token_lengths.encoded_lengths(no_docs))).count() == 0
