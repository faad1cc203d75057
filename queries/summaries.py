"""Summaries, top lists, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glebe.operators import filters, hours, spatial, summaries
from glebe.plans import jobs
from glebe.session import scratch_path
from glebe.sources import tables
from queries.registry import query
from queries.spatial import SITE_KM
from queries.standins import SITE_LAT, SITE_LON, standin, table, with_tables


@query(with_tables("quotes") + """ SELECT min(annee) AS premiere_annee, max(annee) AS derniere_annee, count(*) AS n_cotations, count(DISTINCT produit) AS n_produits,
  count(DISTINCT marche) AS n_marches, count(DISTINCT origine) AS n_origines FROM quotes""")
def quote_summary(spark, sf):
    return summaries.quote_summary(standin(spark, sf, "quotes"))


@query(with_tables("quotes") + " SELECT marche, count(*) AS n FROM quotes GROUP BY marche")
def quotes_per_market(spark, sf):
    return summaries.quotes_per_market(standin(spark, sf, "quotes"))


@query(with_tables("quotes") + " SELECT produit, count(*) AS n FROM quotes GROUP BY produit ORDER BY n DESC, produit LIMIT 50")
def top_products(spark, sf):
    return summaries.top_products(standin(spark, sf, "quotes"))


@query(with_tables("groundwater") + """ SELECT count(*) AS n_mesures, count(DISTINCT code_bss) AS n_stations, min(date_mesure) AS premiere_date, max(date_mesure) AS derniere_date,
  round(avg(profondeur_nappe), 2) AS prof_moy_m, round(min(profondeur_nappe), 2) AS prof_min_m, round(max(profondeur_nappe), 2) AS prof_max_m FROM groundwater""")
def groundwater_summary(spark, sf):
    return summaries.groundwater_summary(standin(spark, sf, "groundwater"))


@query(with_tables("groundwater") + """ SELECT code_bss, count(*) AS n, min(date_mesure) AS debut, max(date_mesure) AS fin, round(avg(profondeur_nappe), 2) AS prof_moy_m
  FROM groundwater GROUP BY code_bss""")
def groundwater_per_station(spark, sf):
    return summaries.groundwater_per_station(standin(spark, sf, "groundwater"))


@query(with_tables("groundwater") + """ SELECT code_bss, date_mesure AS date_m, round(profondeur_nappe, 2) AS prof_m, round(niveau_eau_ngf, 2) AS ngf_m, qualification FROM groundwater
  WHERE date_mesure >= DATE '2001-08-01' - 90 ORDER BY code_bss, date_mesure DESC, profondeur_nappe, niveau_eau_ngf LIMIT 100""")
def recent_measures(spark, sf):
    return filters.recent_measures(standin(spark, sf, "groundwater"), dt.date(2001, 8, 1), 90)


WELLS = with_tables("wells") + f", placed AS (SELECT *, round({SITE_KM}, 2) AS distance_km FROM wells)"


def _wells(spark, sf):
    return spatial.with_distance(standin(spark, sf, "wells"), SITE_LAT, SITE_LON, decimals=2)


@query(WELLS + """ SELECT count(*) AS n_stations, count(DISTINCT code_departement) AS n_depts, round(min(distance_km), 1) AS dist_min_km, round(max(distance_km), 1) AS dist_max_km,
  round(avg(profondeur_investigation), 1) AS prof_moy_m, count(DISTINCT code_bdlisa) AS n_masses_eau FROM placed""")
def wells_summary(spark, sf):
    return summaries.wells_summary(_wells(spark, sf))


@query(WELLS + " SELECT nom_departement, count(*) AS n, round(avg(profondeur_investigation), 1) AS prof_moy_m FROM placed GROUP BY 1")
def wells_per_department(spark, sf):
    return summaries.wells_per_department(_wells(spark, sf))


@query(with_tables("crops") + " SELECT count(*) AS n_parcelles, round(sum(surface_ha), 0) AS surface_totale_ha, count(DISTINCT code_culture) AS n_cultures FROM crops")
def crop_parcel_summary(spark, sf):
    return summaries.crop_parcel_summary(standin(spark, sf, "crops"))


@query(with_tables("crops") + " SELECT code_culture AS libelle_culture, count(*) AS n, round(sum(surface_ha), 1) AS ha FROM crops GROUP BY 1 ORDER BY ha DESC, 1 LIMIT 10")
def top_crops(spark, sf):
    return summaries.top_crops(standin(spark, sf, "crops").withColumnRenamed("code_culture", "libelle_culture"))


@query(with_tables("hours") + """ SELECT count(*) AS n_entrees, round(sum(duree_h), 1) AS total_heures, min(date) AS premiere_date, max(date) AS derniere_date, count(DISTINCT poste) AS n_postes FROM hours""")
def hours_summary(spark, sf):
    return summaries.hours_summary(standin(spark, sf, "hours"))


@query(with_tables("hours") + " SELECT poste, count(*) AS n, round(sum(duree_h), 1) AS heures FROM hours GROUP BY poste")
def hours_per_task(spark, sf):
    return summaries.hours_per_task(standin(spark, sf, "hours"))


@query(with_tables("hours") + " SELECT id, date, poste, duree_h FROM hours ORDER BY date DESC, id DESC LIMIT 15")
def last_entries(spark, sf):
    return hours.last_entries(standin(spark, sf, "hours")).select("id", "date", "poste", "duree_h")


@query("SELECT CAST(year(o_orderdate) AS INT) AS annee, count(*) AS n FROM orders GROUP BY 1")
def rows_per_year(spark, sf):
    return summaries.rows_per(table(spark, sf, "orders").withColumn("annee", F.year("o_orderdate")))


@query("SELECT CAST(o_orderkey % 5 AS BIGINT) AS lot, count(*) AS n FROM orders GROUP BY 1")
def rows_per_file(spark, sf):
    """One file per lot."""
    orders, path = table(spark, sf, "orders").withColumn("lot", F.col("o_orderkey") % 5), scratch_path(spark, "lots")
    for lot in range(5):
        orders.filter(F.col("lot") == lot).coalesce(1).write.parquet(f"{path}/lot-{lot}")
    counts = summaries.rows_per(spark.read.parquet(f"{path}/*").drop("lot"), "_file")
    return counts.select(F.regexp_extract("_file", "lot-([0-9])", 1).cast("bigint").alias("lot"), "n")


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, sf):
    return summaries.distinct_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"))


def _status_sql(source: str, last: str, table_: str, limit: int) -> str:
    age = f"date_diff('day', max({last}), DATE '2024-02-01')"
    return f"""SELECT '{source}' AS source, max({last}) AS last_update, CAST({age} AS INT) AS days_old, count(*) AS row_count,
      CASE WHEN {age} <= {limit} THEN '{summaries.FRESH}' ELSE '{summaries.OLD}' END AS status,
      CASE WHEN {age} > {limit} THEN concat('Pas d''update depuis ', {age}, ' jours') END AS alert FROM {table_}"""


@query(with_tables("weather", "groundwater", "quotes") + " " + _status_sql("meteo", "date", "weather", 3) + " UNION ALL "
       + _status_sql("prix", "TRY_CAST(try_strptime(date, '%d/%m/%Y') AS DATE)", "quotes", 10)
       + " UNION ALL " + _status_sql("nappes", "date_mesure", "groundwater", 365)
       + f" UNION ALL SELECT 'absent', NULL, NULL, 0, '{summaries.FAILED}', 'no files found at nowhere'"
       + f" UNION ALL SELECT unnest(['sans_date', 'illisible']), NULL, NULL, 0, '{summaries.FAILED}', 'unreadable'")
def lake_status(spark, sf):
    last = {"weather": F.col("date"), "quotes": summaries.quote_last_date(), "groundwater": F.col("date_mesure")}
    names = {"meteo": "weather", "prix": "quotes", "nappes": "groundwater"}
    sources = {}
    for name, standin_name in names.items():
        path = scratch_path(spark, name)
        tables.write_all(standin(spark, sf, standin_name), path)
        sources[name] = (path, last[standin_name])
    damaged = scratch_path(spark, "damaged")
    spark.range(1).select(F.lit("PAR1 and no more").alias("value")).write.text(damaged)
    broken = {"absent": (scratch_path(spark, "nowhere"), F.col("date")), "sans_date": (sources["meteo"][0], F.col("jour")), "illisible": (damaged, F.col("date"))}
    status = jobs.lake_status(spark, {**sources, **broken}, dt.date(2024, 2, 1))
    return status.withColumn("alert", F.when(F.col("source").isin("sans_date", "illisible"), "unreadable").otherwise(
        F.regexp_replace("alert", "found at .*", "found at nowhere")))
