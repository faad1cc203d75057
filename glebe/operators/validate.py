"""Parcel records: defaults, constraints, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.schemas import PARCEL_DEFAULTS, PARCEL_ENUMS, PARCEL_RANGES, PARCEL_REQUIRED


def with_defaults(parcels: DataFrame) -> DataFrame:
    """Fill missing categories, notes and status; both dates default to the current UTC time."""
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in PARCEL_DEFAULTS.items() if c in parcels.columns}
    now = F.to_timestamp_ntz(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("string"))
    filled |= {c: F.coalesce(c, now) for c in ("date_creation", "date_modification") if c in parcels.columns}
    return parcels.withColumns(filled)


def broken_rules(columns: list[str]) -> Column:
    """Texts of the constraints a row breaks: required fields, ranges, allowed values."""
    rules = []
    for name in PARCEL_REQUIRED:
        missing = F.col(name).isNull() if name in columns else F.lit(True)
        rules.append(F.when(missing, F.lit(f"{name}: required")))
    for name, (low, high) in PARCEL_RANGES.items():
        if name in columns:
            bad = F.col(name) < low
            if high is not None:
                bad = bad | (F.col(name) > high)
            rules.append(F.when(bad, F.lit(f"{name}: outside {low}..{'' if high is None else high}")))
    for name, allowed in PARCEL_ENUMS.items():
        if name in columns:
            rules.append(F.when(~F.col(name).isin(*allowed), F.lit(f"{name}: not one of {'/'.join(allowed)}")))
    return F.array_compact(F.array(*rules))


def check_parcels(parcels: DataFrame) -> DataFrame:
    """Parcels with defaults filled and ``errors``, the list of broken rules."""
    filled = with_defaults(parcels)
    return filled.withColumn("errors", broken_rules(filled.columns))


def split_parcels(parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): the quarantine keeps ``errors``."""
    checked = check_parcels(parcels)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
