"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 0) -> Column:
    """Round on the binary value, halves away from zero: 2.675 gives 2.67.

    Spark's own ``round`` works on the shortest decimal text and gives 2.68 there; the dashboards and
    summaries this library reproduces round the binary value.
    """
    value = F.col(c) if isinstance(c, str) else c
    if digits == 0:
        return F.round(value, 0)
    scale = F.lit(10.0**digits)
    return F.round(value * scale, 0) / scale


def rounded_quickly(c: Column | str, digits: int) -> Column:
    """As ``rounded``, but numbers from 0 to 2**52 (times the scale) do without the decimal text that Spark's ``round``
    makes of a number, which takes longer than working out a distance. For columns of very many rows."""
    value = F.col(c) if isinstance(c, str) else c
    scale = F.lit(10.0**digits)
    scaled = value * scale
    whole = F.floor(scaled).cast("double")
    plain = whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when((scaled >= 0.0) & (scaled < 2.0**52), plain).otherwise(F.round(scaled, 0)) / scale
