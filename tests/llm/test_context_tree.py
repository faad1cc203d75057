import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from glebe.llm import context_tree as ct


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTrees:
    """Nodes by (context, prefix) over the training texts."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        for text in texts:
            data = self.padded(text)
            for gram, n in Counter(data[i - depth:i + 1] for i in range(depth, len(data))).items():
                for prefix, bit in self.decisions(gram[depth]):
                    for level in range(depth + 1):
                        self.counts[(gram[depth - level:depth], prefix)][bit] += n
        self.weighted, below = {}, defaultdict(float)
        for node in sorted(self.counts, key=lambda n: -len(n[0])):
            own = log_kt(*self.counts[node])
            w = own if len(node[0]) == depth else np.logaddexp(own, below[node]) - math.log(2)
            self.weighted[node] = w
            below[(node[0][1:], node[1])] += w

    def padded(self, text):
        return b"\xff" * self.depth + text.encode().lower() + b"\xff"

    @staticmethod
    def decisions(byte):
        return [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    def score(self, text):
        data, total = self.padded(text), 0.0
        for i in range(self.depth, len(data)):
            for prefix, bit in self.decisions(data[i]):
                p = None
                for level in range(self.depth, -1, -1):
                    node = (data[i - level:i], prefix)
                    zeros, ones = self.counts.get(node, (0, 0))
                    estimate = (ones + 0.5) / (zeros + ones + 1)
                    if level == self.depth:
                        p = estimate
                    else:
                        share = math.exp(log_kt(zeros, ones) - math.log(2) - self.weighted.get(node, 0.0))
                        p = share * estimate + (1 - share) * p
                total += math.log10(p if bit else 1 - p)
        return total


def corpus():
    texts = [(i, prose(i, 30 + i % 50)) for i in range(40)] + [(50, "ÀÉ Zug\tUP\n\x0b" * 5), (51, "only held unheard-of words")]
    return [*texts, (52, ""), (53, None), (None, "null id"), (54, "a" * 3000), (3, prose(3, 33))]


@pytest.mark.parametrize(("depth", "slot"), [(2, 10**6), (4, 50), (5, 500)])
def test_scores_match_plain_trees(spark, monkeypatch, depth, slot):
    monkeypatch.setattr(ct, "SLOT_GRAMS", slot)
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    training = [t or "" for i, t in rows if not held(i)]
    trees = PlainTrees(training, depth)
    tokens = Counter(w for t in training for w in [*t.encode().lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    wanted = {}
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words)
        wanted[i] = (held(i), len(words), sum(tokens[w] > 0 for w in words), n, base, trees.score(t or ""))
    result = ct.score_texts(frame, depth=depth).collect()
    assert Counter(r.id for r in result) == Counter(i for i, _ in rows)
    for r in result:
        assert (r.held, r.n_tokens, r.n_known, r.train_tokens) == wanted[r.id][:4]
        assert r.base_score == pytest.approx(wanted[r.id][4], rel=1e-9)
        assert r.score == pytest.approx(wanted[r.id][5], rel=1e-12)
    assert sum(held(i) for i, _ in rows) and got is not None


def test_small_blocks_give_the_same_scores(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(2)
    whole = sorted((r.id or 0, round(r.score, 3)) for r in ct.score_texts(frame, depth=3).collect())
    monkeypatch.setattr(ct, "BLOCK_BYTES", 300)
    monkeypatch.setattr(ct, "_CHUNK", 100)
    monkeypatch.setattr(ct, "MOST_BUCKETS", 3)
    assert sorted((r.id or 0, round(r.score, 3)) for r in ct.score_texts(frame, depth=3).collect()) == whole


def test_chances_of_all_next_bytes_sum_to_one(spark):
    train = {int.from_bytes(b"abcab" + bytes([c]), "big"): n for c, n in ((97, 5), (98, 1), (255, 2))}
    contexts = (b"abcab", b"xxcab", b"zzzzz")
    keys = np.array(sorted({int.from_bytes(x + bytes([c]), "big") for x in contexts for c in range(256)}))
    counts = np.array([train.get(k, 0) for k in keys.tolist()])
    rows = [(0, ct._pack_ints(keys), ct._pack_ints(counts))]
    upper = ct._upper(ct.top_nodes(spark.createDataFrame(rows, "bucket int, keys binary, n binary"), 5))
    scores = dict(zip(keys.tolist(), ct.gram_scores(keys, counts, upper, 5)))
    for x in contexts:
        assert sum(10 ** scores[int.from_bytes(x + bytes([c]), "big")] for c in range(256)) == pytest.approx(1)


def test_packed_numbers_and_words():
    for numbers in ([0], [5, 5, 9, 2**47], [3, -1, 2**62, 0]):
        assert ct._unpack_ints(ct._pack_ints(np.array(numbers))).tolist() == numbers
    assert ct._unpack_words(ct._pack_words([b"a", b"\xff", b"z"])) == [b"a", b"\xff", b"z"]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 63.5, 64.0, 64.5, 1000.0, 1e6 + 0.5, 1e12])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-12)


def test_held_out_texts_are_shorter_than_by_words(spark):
    docs = spark.createDataFrame([(i, prose(i, 400)) for i in range(150)], "doc_id int, text string")
    sums = ct.score_texts(docs).filter("held").agg(F.sum("score").alias("s"), F.sum("n_bytes").alias("n")).first()
    assert -sums.s / math.log10(2) / sums.n < 2.5


def test_odd_and_no_documents(odd_docs, no_docs, spark):
    assert ct.score_texts(odd_docs).count() == odd_docs.count()
    assert ct.score_texts(no_docs).count() == 0
    only_held = spark.createDataFrame([(1, "x y")], "doc_id int, text string")
    row = ct.score_texts(only_held, held=F.lit(True)).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)
    assert row.score == pytest.approx(-4 * 8 * math.log10(2))
