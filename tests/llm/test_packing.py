import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glebe.llm import packing


def expand(plan):
    """Lengths in each sequence, with their offsets."""
    bins = defaultdict(list)
    for length, low, high, base, offset, copies in plan:
        for i in range(high - low):
            bins[base + i // copies].append((offset + i % copies * length, length))
    return bins


def check_plan(histogram, capacity):
    bins = expand(packing.packing_plan(dict(histogram), capacity))
    assert Counter(length for b in bins.values() for _, length in b) == Counter(histogram)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    intervals = defaultdict(list)
    for length, low, high, *_ in packing.packing_plan(dict(histogram), capacity):
        intervals[length].append((low, high))
    for length, n in histogram.items():
        bounds = sorted(intervals[length])
        assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    return len(bins)


def fewest(sizes, capacity):
    """Bins of an optimal packing, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominating_sets_keep_an_optimal_packing(sizes):
    left = dict(Counter(sizes))
    fixed = packing._dominating_sets(left, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(times for _, times in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)
    assert check_plan(Counter(sizes), 20) >= fewest(sizes, 20)


def test_plan_of_a_large_histogram():
    rng = random.Random(3)
    histogram = {size: rng.randrange(0, 5000) for size in range(1, 2049)}
    histogram = {k: v for k, v in histogram.items() if v}
    bins = check_plan(histogram, 2048)
    total = sum(k * v for k, v in histogram.items())
    assert len(packing.packing_plan(histogram, 2048)) < 4 * 2048 * 64
    assert bins <= 1.02 * -(-total // 2048)


def test_plan_with_one_hot_length():
    assert check_plan({7: 1_000, 3: 2}, 20) == 500
    assert check_plan({1: 50}, 20) == 3
    assert packing.packing_plan({}, 20) == []


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_the_ids_of_the_json_vocabulary(spark, odd_docs):
    rows = spark.createDataFrame([(1, "a <|endoftext|> b  c\xa0d  \n\n e'll 12345 ĳ"), (2, None), (3, "ñ" * 9000)], "doc_id int, text string")
    pieces = packing.pack(packing.encode_pieces(rows).withColumn("crc", F.crc32("ids"))).collect()
    for r in rows.collect():
        ids = np.array(reference_ids(r.text), "<u4")
        own = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes()
        assert all(p.length == 2048 for p in own[1:]) and 1 <= own[0].length <= 2048
        assert all(p.crc == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in own)


def test_odd_documents_are_packed_whole(odd_docs):
    packed = packing.pack(packing.encode_pieces(odd_docs)).collect()
    assert sum(p.length for p in packed) == sum(len(reference_ids(r.text)) for r in odd_docs.select("text").collect())
    at = defaultdict(int)
    for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at[p.sequence_id]
        at[p.sequence_id] += p.length
    assert max(at.values()) <= 2048


def test_empty_and_bad_lengths(spark, no_docs):
    assert packing.pack(packing.encode_pieces(no_docs)).count() == 0
    for length in (0, 2049, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(length,)], "length bigint"))


def test_pack_keeps_other_columns(spark):
    rows = spark.createDataFrame([(5, "a", "old"), (6, "b", "old")], "length int, row string, offset string")
    out = packing.pack(rows, capacity=10)
    assert out.columns == ["length", "row", "sequence_id", "offset"]
    assert {r.row for r in out.collect()} == {"a", "b"}
