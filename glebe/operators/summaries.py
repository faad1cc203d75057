"""Table summaries, freshness and top lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.functions.dates import quote_date
from glebe.functions.numbers import rounded


def weather_summary(weather: DataFrame) -> DataFrame:
    """Date span, days, mean maximum and minimum (1 decimal), total rain (whole mm)."""
    return weather.agg(
        F.min("date").alias("premiere_date"), F.max("date").alias("derniere_date"),
        F.count(F.lit(1)).alias("n_jours"),
        rounded(F.avg("temperature_2m_max"), 1).alias("tmax_moy_c"),
        rounded(F.avg("temperature_2m_min"), 1).alias("tmin_moy_c"),
        rounded(F.sum("precipitation_sum"), 0).alias("pluie_totale_mm"),
    )


def _distinct(column: str, approximate: bool) -> Column:
    return F.approx_count_distinct(column) if approximate else F.countDistinct(column)


def quote_summary(quotes: DataFrame, approximate: bool = False) -> DataFrame:
    """Year span, quotes, distinct products, markets and origins (sketched when ``approximate``)."""
    return quotes.agg(
        F.min("annee").alias("premiere_annee"), F.max("annee").alias("derniere_annee"),
        F.count(F.lit(1)).alias("n_cotations"),
        _distinct("produit", approximate).alias("n_produits"),
        _distinct("marche", approximate).alias("n_marches"),
        _distinct("origine", approximate).alias("n_origines"),
    )


def quotes_per_market(quotes: DataFrame) -> DataFrame:
    counts = quotes.groupBy("marche").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col("marche").asc_nulls_last())


def top_products(quotes: DataFrame, n: int = 50) -> DataFrame:
    counts = quotes.groupBy("produit").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col("produit").asc_nulls_last()).limit(n)


def groundwater_summary(measures: DataFrame) -> DataFrame:
    return measures.agg(
        F.count(F.lit(1)).alias("n_mesures"), F.countDistinct("code_bss").alias("n_stations"),
        F.min("date_mesure").alias("premiere_date"), F.max("date_mesure").alias("derniere_date"),
        rounded(F.avg("profondeur_nappe"), 2).alias("prof_moy_m"),
        rounded(F.min("profondeur_nappe"), 2).alias("prof_min_m"),
        rounded(F.max("profondeur_nappe"), 2).alias("prof_max_m"),
    )


def groundwater_per_station(measures: DataFrame) -> DataFrame:
    """Per station: measures, span, mean depth; most measures first."""
    return measures.groupBy("code_bss").agg(
        F.count(F.lit(1)).alias("n"), F.min("date_mesure").alias("debut"), F.max("date_mesure").alias("fin"),
        rounded(F.avg("profondeur_nappe"), 2).alias("prof_moy_m"),
    ).orderBy(F.desc("n"), F.col("code_bss").asc_nulls_last())


def wells_summary(wells: DataFrame) -> DataFrame:
    return wells.agg(
        F.count(F.lit(1)).alias("n_stations"), F.countDistinct("code_departement").alias("n_depts"),
        rounded(F.min("distance_km"), 1).alias("dist_min_km"), rounded(F.max("distance_km"), 1).alias("dist_max_km"),
        rounded(F.avg("profondeur_investigation"), 1).alias("prof_moy_m"),
        F.countDistinct("code_bdlisa").alias("n_masses_eau"),
    )


def wells_per_department(wells: DataFrame) -> DataFrame:
    return wells.groupBy("nom_departement").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("profondeur_investigation"), 1).alias("prof_moy_m"),
    ).orderBy(F.desc("n"), F.col("nom_departement").asc_nulls_last())


def crop_parcel_summary(parcels: DataFrame) -> DataFrame:
    return parcels.agg(
        F.count(F.lit(1)).alias("n_parcelles"), rounded(F.sum("surface_ha"), 0).alias("surface_totale_ha"),
        F.countDistinct("code_culture").alias("n_cultures"),
    )


def top_crops(parcels: DataFrame, n: int = 10) -> DataFrame:
    """Crops with the largest area: parcels and hectares (1 decimal)."""
    areas = parcels.groupBy("libelle_culture").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("surface_ha"), 1).alias("ha"))
    return areas.orderBy(F.desc("ha"), F.col("libelle_culture").asc_nulls_last()).limit(n)


def hours_summary(hours: DataFrame) -> DataFrame:
    return hours.agg(
        F.count(F.lit(1)).alias("n_entrees"), rounded(F.sum("duree_h"), 1).alias("total_heures"),
        F.min("date").alias("premiere_date"), F.max("date").alias("derniere_date"),
        F.countDistinct("poste").alias("n_postes"),
    )


def hours_per_task(hours: DataFrame) -> DataFrame:
    return hours.groupBy("poste").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("duree_h"), 1).alias("heures"),
    ).orderBy(F.col("heures").desc_nulls_last(), F.col("poste").asc_nulls_last())


def date_span(df: DataFrame, date: str = "date") -> DataFrame:
    """First and last date; one row of nulls for an empty table."""
    return df.agg(F.min(date).alias("date_min"), F.max(date).alias("date_max"))


def rows_per(df: DataFrame, by: str = "annee") -> DataFrame:
    """Rows per year, or per file with ``by`` = "_file"."""
    if by == "_file" and by not in df.columns:
        df = df.withColumn("_file", F.input_file_name())
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(by).asc_nulls_last())


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each full row once."""
    return df.dropDuplicates()


# Freshness labels, and days up to which a source counts as fresh.
FRESH, OLD, FAILED = "✅ À jour", "⚠️ Ancien", "❌ Erreur"
MAX_AGE_DAYS = {"meteo": 3, "prix": 10, "rpg": 365}


STATUS = "source string, last_update date, days_old int, row_count bigint, status string, alert string"


def source_status(df: DataFrame, source: str, last: Column, ref_date: dt.date, max_age: int | None = None) -> DataFrame:
    """One status row: last update, age, rows, status, alert. ``last`` is the date column to take the maximum of."""
    limit = MAX_AGE_DAYS.get(source, 365) if max_age is None else max_age
    counted = df.agg(F.max(last).alias("last_update"), F.count(F.lit(1)).alias("row_count"))
    age = F.datediff(F.lit(ref_date), F.col("last_update"))
    status = F.when(age <= limit, FRESH).when(age.isNotNull(), OLD).otherwise(FAILED)
    alert = F.when(age <= limit, None).otherwise(
        F.concat(F.lit("Pas d'update depuis "), F.coalesce(age.cast("string"), F.lit("None")), F.lit(" jours")))
    return counted.select(F.lit(source).alias("source"), "last_update", age.alias("days_old"), "row_count",
                          status.alias("status"), alert.alias("alert"))


def failed_source(spark, source: str, error: str) -> DataFrame:
    """Status row of a source that cannot be read; the message is cut at 50 characters."""
    return spark.range(1).select(
        F.lit(source).alias("source"), F.lit(None).cast("date").alias("last_update"),
        F.lit(None).cast("int").alias("days_old"), F.lit(0).cast("bigint").alias("row_count"),
        F.lit(FAILED).alias("status"), F.lit(error[:50]).alias("alert"),
    )


def quote_last_date() -> Column:
    """Quote date for the freshness check, from either date form."""
    return quote_date(F.col("date"))


def file_date() -> Column:
    """Date of the file a row was read from, for sources without a date of their own."""
    return F.col("_metadata.file_modification_time").cast("date")
