"""Registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from glebe.llm import (
    chunks, context_tree, exact_search, infill, mixing, packing, partition_search, privacy, quality, resampling, simhash,
    token_lengths, warc,
)
from glebe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.encode_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


_DRAW = "(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
    SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
steps AS (
    SELECT source, k, rate, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
    FROM rates, (SELECT unnest(range(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 12)::BIGINT FROM rates))) AS k)),
upto AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM steps),
drawn AS (
    SELECT d.doc_id, d.text, d.source, d.lang, d.n_chars, count(u.k) AS n
    FROM documents d JOIN upto u
    ON d.source IS NOT DISTINCT FROM u.source AND u.f <= {_DRAW.format(seed=17, key="d.doc_id")}
    GROUP BY ALL)
SELECT doc_id, text, source, lang, n_chars, unnest(range(0, n))::INTEGER AS copy FROM drawn
""")
def op2_source_mixing(spark, sf_dir):
    """All documents repeated so that sources weigh as the square roots of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("""
WITH sums AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bare AS (
    SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), 'string_agg', '')
        AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS largest
    FROM sums)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM bare
""")
def op3_warc(spark, sf_dir):
    """All pages written as archives and read back."""
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = warc.whole_records(warc.read_archives(spark, path, with_payload=False))
    return found.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("bigint").alias("refers_to"))


@query()
def op4_chunk_dedup(spark, sf_dir):
    """Spans of all documents that repeat passages of other documents or of their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = chunks.repeated_passages(chunks.numbered(docs, "doc_id", "text"))
    return spans.select(F.col("id").alias("doc_id"), "start", "end", "words", F.col("first_ids").alias("first_doc_ids"))


@query()
def op5_context_tree(spark, sf_dir):
    """Log probabilities of all documents, learned from six sevenths of them."""
    scores = context_tree.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scores.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query()
def op6_quality_rules(spark, sf_dir):
    """Statistics and verdict of all documents, by rules learned from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, _ = quality.judge(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         quality.base_failed().alias("base_failed"), "kept")


@query()
def op7_token_lengths(spark, sf_dir):
    """Totals under every context limit, from the lengths of all documents."""
    lengths = token_lengths.encoded_lengths(table(spark, sf_dir, "documents").select("text"))
    return token_lengths.suffix_sums(token_lengths.histogram(lengths))


@query()
def op8_learned_partitions(spark, sf_dir):
    """The 20 nearest of every twentieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = partition_search.search(rows, F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query()
def op9_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.near_duplicate_groups(docs)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query()
def op10_sanitisation(spark, sf_dir):
    """Personal spans of all documents, with those of disclosing terms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = privacy.all_spans(docs, ["doc_id"])
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}")
              for kind in privacy.KINDS]
    return spans.select("doc.doc_id", *counts, F.sha2(privacy.spans_text(F.col("base")), 256).alias("base_sha256"),
                        privacy.spans_text(F.col("spans")).alias("spans"))


@query("""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
drawn AS (
    SELECT *, length(text)::BIGINT AS n, [('0x' || substr(hex, 1 + 8 * i, 8))::BIGINT FOR i IN range(0, 4)] AS h FROM texts),
cuts AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
                THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
cut AS (
    SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
""")
def op11_infill(spark, sf_dir):
    """All documents turned into fill-in-the-middle texts and back."""
    filled = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    restored = infill.restore(filled.withColumn("output_sha256", F.sha2("output", 256)))
    return restored.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                           F.sha2("restored", 256).alias("restored_sha256"))


@query("""
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER () AS row FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score,
           row_number() OVER (PARTITION BY q.row ORDER BY score DESC, c.vec_id)::INTEGER AS rank
    FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM scores WHERE rank <= 10
""")
def op12_exact_topk(spark, sf_dir):
    """The 10 highest integer inner products of every hundredth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = exact_search.search(rows, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


# The CRC is linear over bits: that of a run of bytes is the exclusive or of its start value and its bytes, each shifted
# on by as many bytes as follow. Both are tables made from the polynomial.
_BITWISE = "list_reduce([{}] || range(0, 8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
_SHIFT = "xor({0} >> 8, (SELECT list(t ORDER BY b) FROM bytes)[({0} & 255) + 1])"


@query(f"""
WITH RECURSIVE
texts AS (
    SELECT true AS raw, doc_id, row_number() OVER () AS row, text FROM documents
    UNION ALL SELECT false, item_id, 0, text FROM benchmark),
cut AS (
    SELECT raw, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
    SELECT raw, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                            || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM cut),
bytes AS MATERIALIZED (SELECT b, {_BITWISE.format("b")} AS t FROM (SELECT unnest(range(0, 256)) AS b)),
counted AS MATERIALIZED (SELECT raw, row, g, count(*) AS n FROM grams GROUP BY ALL),
distinct_grams AS MATERIALIZED (SELECT g, hex(encode(g)) AS h, octet_length(encode(g)) AS size FROM (SELECT DISTINCT g FROM counted)),
longest AS (SELECT coalesce(max(size), 0) AS most FROM distinct_grams),
shifted AS (
    SELECT 1::BIGINT AS d, b, t FROM bytes
    UNION ALL SELECT d + 1, b, {_SHIFT.format("t")} FROM shifted WHERE d < (SELECT most FROM longest)),
starts AS (
    SELECT 0::BIGINT AS d, 4294967295::BIGINT AS t
    UNION ALL SELECT d + 1, {_SHIFT.format("t")} FROM starts WHERE d < (SELECT most FROM longest)),
places AS (SELECT g, h, size, unnest(range(0, size)) AS pos FROM distinct_grams),
summed AS (
    SELECT g, any_value(size) AS size, bit_xor(t) AS x
    FROM places JOIN shifted ON d = size - pos AND b = ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT GROUP BY g),
bucketed AS MATERIALIZED (SELECT g, xor(xor(x, t), 4294967295) % 10000 AS bucket FROM summed JOIN starts ON d = size),
held AS MATERIALIZED (SELECT raw, row, bucket, sum(n)::BIGINT AS n FROM counted JOIN bucketed USING (g) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT raw), 0)::DOUBLE AS t FROM held GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain
    FROM sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE raw GROUP BY row),
scored AS (
    SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                      / 4294967296::DOUBLE)))::BIGINT AS score
    FROM cut LEFT JOIN weights USING (row) WHERE raw),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) FILTER (words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM ranked
""")
def op13_resampling(spark, sf_dir):
    """Scores of all documents towards the benchmark's n-grams, and the ranks of the drawn twentieth."""
    scored = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark").select("text"))
    return scored.select("doc.doc_id", "n_features", "weight", "score", "rank")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
