"""Helpers of this package: staged tables, byte words, tokenizer vocabularies."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.session import drop_scratch, scratch_path

_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared work folder and read again: a cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    _staged.append(path)
    df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"}).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def staged_so_far() -> int:
    """A mark for ``forget_staged``."""
    return len(_staged)


def forget_staged(spark, first: int, last: int | None = None) -> None:
    """Delete what was staged from one mark on, up to another; what reads it must have been written by now."""
    for path in _staged[first:last]:
        if path:
            drop_scratch(spark, path)
    _staged[first:last] = [""] * len(_staged[first:last])


def reads_staged(df: DataFrame, first: int, last: int | None = None) -> bool:
    """Whether rows are still to be read from what was staged between two marks."""
    staged = [path.split(":", 1)[-1].lstrip("/") + "/" for path in _staged[first:last] if path]
    return any(part in file for file in (df.inputFiles() if staged else ()) for part in staged)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that they travel beside an operator's own columns without clashes."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes of rows handed to Python at a time, so that a worker's memory does not hang on how long texts are.
BATCH_BYTES = "4m"


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes; a longer row is a batch of its own."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def rows_of(batch, *columns: str):
    """Python values of some columns of an Arrow batch, row by row."""
    return zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


@lru_cache(maxsize=4)
def byte_pair_encoding(vocabulary: str):
    """The byte-pair encoder of a rank file, built once per Python worker.

    ``vocabulary`` is a path, or the bare name of a file that the public tokenizer package holds. The rank file of
    a vocabulary gives the same ids as its JSON file; special tokens inside a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
