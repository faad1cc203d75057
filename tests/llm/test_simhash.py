import random
import re

import pytest
import xxhash
from llm_texts import prose

from glebe.llm import simhash
from glebe.llm.components import components


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def joined(nodes, near):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def distance(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_fingerprints_of_odd_documents(odd_docs):
    got = sorted((r.id or 0, r.fp) for r in simhash.fingerprints(odd_docs).collect())
    assert got == sorted((r.doc_id or 0, fingerprint(r.text)) for r in odd_docs.select("doc_id", "text").collect())
    assert fingerprint("") == 0


def random_prints(n, seed):
    """Groups whose members lie some bits apart, with the extremes."""
    rng, out = random.Random(seed), {0, -1, 1 << 62, -(1 << 63)}
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            for bit in rng.sample(range(64), rng.choice((1, 1, 2, 3))):
                base ^= 1 << bit
            out.add(base - (1 << 64) if base >> 63 else base)
    return sorted(out)


@pytest.mark.parametrize("tree_size", [8192, 5])
def test_links_join_what_all_pairs_join(spark, tree_size):
    prints = random_prints(300, 4)
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint").repartition(3)
    told = [(r.a, r.b) for r in simhash.links(frame, 2, tree_size).collect()]
    assert all(distance(a, b) <= 2 for a, b in told)
    wanted = joined(prints, lambda a, b: distance(a, b) <= 2)
    linked = set(told) | {(b, a) for a, b in told}
    assert joined(prints, lambda a, b: (a, b) in linked) == wanted


def test_a_dense_group_in_one_shard_yields_few_links(spark):
    prints = [1 << i | 1 << j for i in range(20) for j in range(i)]
    told = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 2, 50).count()
    assert told < 40 * len(prints)
    roots = components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 2, 50)).collect()
    assert len({r.root for r in roots}) == 1 and len(roots) == len(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 199), (200, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    wanted = joined(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == wanted
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_match_all_pairs(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(120):
        words = prose(i // 4, 300).split()
        if i % 4:
            words[rng.randrange(300)] = "changed"
        texts[i + 5] = " ".join(words)
    texts |= {1: None, 2: "", 3: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.id: r.component for r in simhash.near_duplicate_groups(docs).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert got == joined(sorted(texts), lambda a, b: distance(prints[a], prints[b]) <= 2)


def test_null_ids_and_one_of_each_group_stays(odd_docs, no_docs):
    groups = simhash.near_duplicate_groups(odd_docs)
    assert groups.count() == odd_docs.count()
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = sorted((r.doc_id or 0) for r in kept.collect())
    assert rows == [1, 4, 5, 7, 8, 9, 10]
    assert simhash.near_duplicate_groups(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_a_group_of_null_ids_keeps_one(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "e f g h")], "doc_id string, text string")
    assert simhash.keep_one(docs).count() == 2
