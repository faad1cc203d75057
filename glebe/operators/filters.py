"""Selections on landed files and tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.functions.text import clean_department
from glebe.operators.spatial import within_box


def _folded(c: Column) -> Column:
    return F.upper(F.trim(c))


def member_of(df: DataFrame, column: str, wanted: list[str] | DataFrame | None) -> DataFrame:
    """Rows whose text is listed, ignoring case and outer blanks; an empty list keeps all.

    A long list can be given as a one-column table.
    """
    if wanted is None:
        return df
    if isinstance(wanted, DataFrame):
        listed = wanted.select(_folded(F.col(wanted.columns[0])).alias("_wanted")).distinct()
        return df.join(listed, _folded(F.col(column)) == F.col("_wanted"), "left_semi")
    if not wanted:
        return df
    return df.filter(_folded(F.col(column)).isin(*(w.strip().upper() for w in wanted)))


def quotes_of(quotes: DataFrame, markets=None, stages=None) -> DataFrame:
    """Quotes of the listed markets and trade stages."""
    return member_of(member_of(quotes, "marche", markets), "stade", stages)


def in_departments(df: DataFrame, departments: list[str] | None, column: str = "code_departement") -> DataFrame:
    """Rows of the listed departments; leading zeros do not matter ("072" = "72"), others do ("10")."""
    codes = [str(d).strip().lstrip("0") for d in departments or [] if d is not None]
    codes = [c for c in codes if c]
    return df.filter(clean_department(F.col(column)).isin(*codes)) if codes else df


def sales_of(sales: DataFrame, departments: list[str] | None = None, lat: float | None = None,
             lon: float | None = None, radius_km: float | None = None) -> DataFrame:
    """Sales of the departments inside the box around a point; parts not given do not filter."""
    kept = in_departments(sales, departments)
    if lat is not None and lon is not None and radius_km:
        kept = within_box(kept, lat, lon, radius_km)
    return kept


def date_range(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
               date: str = "date", year: str | None = "annee") -> DataFrame:
    """Rows dated between start and end, both included and both optional.

    Where the table is partitioned by year the matching bound on the year is added, so that whole
    partitions are skipped.
    """
    by_year = year if year in df.columns else None
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start))
        if by_year:
            df = df.filter(F.col(by_year) >= start.year)
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end))
        if by_year:
            df = df.filter(F.col(by_year) <= end.year)
    return df


def recent_measures(groundwater: DataFrame, ref_date: dt.date, n_days: int = 90, limit: int = 100) -> DataFrame:
    """Measures of the last days, per station newest first, at most ``limit`` rows."""
    kept = groundwater.filter(F.col("date_mesure") >= F.date_sub(F.lit(ref_date), n_days))
    return kept.orderBy(
        F.col("code_bss").asc_nulls_last(), F.col("date_mesure").desc_nulls_last(), "profondeur_nappe", "niveau_eau_ngf",
    ).limit(limit).select(
        "code_bss", F.col("date_mesure").alias("date_m"), rounded("profondeur_nappe", 2).alias("prof_m"),
        rounded("niveau_eau_ngf", 2).alias("ngf_m"), "qualification",
    )


def files_of_years(manifest: DataFrame, years: list[int], formats: tuple[str, ...] = ("CSV", "ZIP")) -> DataFrame:
    """Landed files of the wanted years in (year, quarter) order, a missing part counting as 0.

    Stops with the available years when none matches.
    """
    matched = manifest.filter(F.col("annee").isin(*years))
    if matched.isEmpty():
        known = manifest.select("annee").distinct().filter(F.col("annee").isNotNull()).orderBy("annee")
        raise ValueError(f"no file for {years}; available years: {[r.annee for r in known.collect()]}")
    return matched.filter(F.col("format").isin(*formats)).orderBy(
        F.coalesce("annee", F.lit(0)), F.coalesce("trimestre", F.lit(0)), "path")
