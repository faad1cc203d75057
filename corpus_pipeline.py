"""A training corpus from raw documents: quality rules, near-duplicates, personal data, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of the documents they get, whatever those are. What a stage has
staged for its result is deleted when the next stage starts on documents that are read from elsewhere, since the result has
been written by then; stages that are chained without a write keep what they read.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glebe.llm import mixing, packing, privacy, quality, simhash
from glebe.llm.common import forget_staged, reads_staged, stage, staged_so_far

#: By thread and folder: marks of what the last stage called there has staged.
_last: dict[tuple[int, str], tuple[str, int, int]] = {}


def _tidy(function):
    """A stage that deletes what the stage before it has staged, unless the documents it gets are still read from there."""
    name = function.__name__

    @wraps(function)
    def tidy(spark, docs, sf_dir):
        run = (threading.get_ident(), sf_dir)
        before = _last.pop(run, None)
        if before and _follows(name, before[0]) and not reads_staged(docs, *before[1:]):
            forget_staged(spark, *before[1:])
        first = staged_so_far()
        out = function(spark, docs, sf_dir)
        _last[run] = (name, first, staged_so_far())
        return out

    return tidy


def _follows(name: str, before: str) -> bool:
    order = [stage_name for stage_name, _ in STAGES]
    return order.index(name) == order.index(before) + 1


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rules learned from the labels keep; a null text is rejected."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at two bits: the least doc_id."""
    return simhash.keep_one(docs, shingle=3, radius=2)


@_tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised and disclosing terms removed; n_chars follows the text."""
    clean = privacy.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


@_tidy
def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson draws towards weights that even the sources out, in random order."""
    return mixing.mix(docs, copy_col=None)


@_tidy
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, packed into sequences of 2048 tokens."""
    return packing.pack(packing.encode_pieces(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("source_mixture", source_mixture), ("sequences", sequences)]

#: Learned rules, fingerprint components and byte-pair ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are staged in the shared work folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, function in STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        mark = staged_so_far()
        docs = stage(out, name)
        if before is not None:
            forget_staged(spark, before, before + 1)
        before = mark
    return STAGES[-1][1](spark, docs, sf_dir)
