"""Domain tables derived from the given tables, in SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SITE_LAT, SITE_LON = 47.0, 1.5
RADIUS_KM = 20.0


def _d(number) -> str:
    return f"CAST({number} AS DOUBLE)"


def _coordinate(base: float, spread: str, size: int) -> str:
    return f"{_d(base)} + CAST(({spread}) % {size} AS DOUBLE) / {_d(1000)}"


def _day_text(c: str) -> str:
    return f"concat(lpad(CAST(day({c}) AS STRING), 2, '0'), '/', lpad(CAST(month({c}) AS STRING), 2, '0'), '/', CAST(year({c}) AS STRING))"


TEXTS = {
    # Candidate parcels.
    "parcels": f"""
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS nom, CAST(1 + c_custkey % 9 AS DOUBLE) AS surface_ha,
          c_mktsegment AS commune, CAST(c_nationkey AS STRING) AS departement,
          {_coordinate(42, 'c_custkey * 7919', 9000)} AS lat, {_coordinate(-4.5, 'c_custkey * 104729', 12000)} AS lon,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal * {_d(2)} END AS prix_achat,
          {_d('NULL')} AS prix_location_annuel,
          CASE c_custkey % 6 WHEN 0 THEN 'reseau' WHEN 1 THEN 'riviere' WHEN 2 THEN 'forage' WHEN 3 THEN 'aucun' WHEN 4 THEN 'forage' ELSE 'inconnu' END AS acces_eau,
          CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 40 AS DOUBLE) / {_d(10)} END AS debit_estime_m3h,
          {_d('NULL')} AS distance_cours_eau_m,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 13) % 400 AS DOUBLE) / {_d(10)} END AS pente_pct,
          CASE c_custkey % 10 WHEN 0 THEN 'S' WHEN 1 THEN 'SE' WHEN 2 THEN 'SO' WHEN 3 THEN 'E' WHEN 4 THEN 'O' WHEN 5 THEN 'NE' WHEN 6 THEN 'NO' WHEN 7 THEN 'N' ELSE 'plat' END AS exposition,
          CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 31) % 12000 AS DOUBLE) / {_d(10)} END AS altitude_m,
          CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS risque_gel_tardif,
          CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 600 AS DOUBLE) / {_d(10)} END AS distance_marche_km,
          {_d('NULL')} AS distance_agglo_km,
          CASE c_custkey % 4 WHEN 0 THEN 'facile' WHEN 1 THEN 'limite' WHEN 2 THEN 'difficile' ELSE 'facile' END AS acces_vehicule,
          '' AS notes, 'prospect' AS statut,
          CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST((c_custkey * 17) % 12000 AS DOUBLE) / {_d(10)} END AS meteo_precip_annuelle_mm,
          CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 27 AS INT) END AS meteo_jours_gel,
          {_d('NULL')} AS meteo_etp_annuelle_mm,
          CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(5000 + (c_custkey * 37) % 9000 AS DOUBLE) END AS prix_comparable_eur_ha,
          CAST(NULL AS INT) AS forages_brgm_count
        FROM {{customer}}""",
    # Parcels whose context is still to be found.
    "bare_parcels": f"""
        SELECT CAST(c_custkey AS STRING) AS id, {_coordinate(42, 'c_custkey * 7919', 9000)} AS lat, {_coordinate(-4.5, 'c_custkey * 104729', 12000)} AS lon
        FROM {{customer}}""",
    "sales": f"""
        SELECT p_partkey AS sale_id, {_coordinate(42, 'p_partkey * 6007 + 17', 9000)} AS latitude,
          {_coordinate(-4.5, 'p_partkey * 15485863 + 5', 12000)} AS longitude,
          CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_retailprice * {_d(10)} END AS valeur_fonciere,
          CASE WHEN p_partkey % 37 = 0 THEN {_d(0)} ELSE CAST(p_size * 1000 AS DOUBLE) END AS surface_terrain
        FROM {{part}}""",
    "wells": f"""
        SELECT concat('W', CAST(s_suppkey AS STRING)) AS code_bss, {_coordinate(42, 's_suppkey * 3571 + 11', 9000)} AS latitude,
          {_coordinate(-4.5, 's_suppkey * 65537 + 29', 12000)} AS longitude, s_acctbal / {_d(100)} AS profondeur_investigation,
          CAST(s_nationkey AS STRING) AS code_departement, concat('Dept ', CAST(s_nationkey AS STRING)) AS nom_departement,
          concat('GF', CAST(s_suppkey % 7 AS STRING)) AS code_bdlisa, s_suppkey * 3 AS nb_mesures_piezo
        FROM {{supplier}}""",
    # Daily weather of one point per user, spread over three years.
    "weather": f"""
        SELECT CAST(make_date(CAST(year(ts) - event_id % 3 AS INT), CAST(month(ts) AS INT), CAST(day(ts) AS INT)) AS DATE) AS date,
          {_coordinate(42, 'user_id * 611', 9000)} AS latitude, {_coordinate(-4.5, 'user_id * 937', 12000)} AS longitude,
          max(value) / {_d(10)} AS temperature_2m_max, min(value) / {_d(10)} - {_d(1)} AS temperature_2m_min,
          max(value) / {_d(20)} AS temperature_2m_mean, max(value) * {_d(0.12371)} AS precipitation_sum,
          min(value) * {_d(0.25347)} AS et0_fao_evapotranspiration, CAST(max(event_id % 90) AS DOUBLE) AS wind_speed_10m_max,
          CAST(min(event_id % 20) AS DOUBLE) AS shortwave_radiation_sum
        FROM {{events}} GROUP BY 1, 2, 3""",
    "quotes": f"""
        SELECT CAST(year(l_shipdate) AS INT) AS annee, CASE WHEN l_linenumber % 50 = 49 THEN 'inconnue' ELSE {_day_text('l_shipdate')} END AS date,
          concat(p_type, ' ', p_name) AS produit, concat('MARCHE ', CAST(l_suppkey % 12 AS STRING)) AS marche, l_returnflag AS stade,
          concat('ORIGINE ', CAST(l_suppkey % 5 AS STRING)) AS origine, l_linestatus AS unite,
          l_extendedprice / l_quantity / {_d(1100)} AS prix_min,
          CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_extendedprice / l_quantity / {_d(1000)} END AS prix_moyen,
          l_extendedprice / l_quantity / {_d(900)} AS prix_max
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "groundwater": f"""
        SELECT concat('W', CAST(o_custkey % 120 AS STRING)) AS code_bss, CAST(o_orderdate AS DATE) AS date_mesure, o_totalprice / {_d(10000)} AS profondeur_nappe,
          o_totalprice / {_d(7000)} AS niveau_eau_ngf, o_orderpriority AS qualification, o_orderkey AS mesure
        FROM {{orders}}""",
    "crops": f"""
        SELECT CAST(o_orderkey AS STRING) AS id_parcel, CAST(o_orderkey % 31 AS STRING) AS code_culture, o_totalprice / {_d(100000)} AS surface_ha,
          CAST((o_orderkey * 13) % 900 AS DOUBLE) / {_d(100)} AS x, CAST(42 + (o_orderkey * 17) % 9 AS DOUBLE) AS y
        FROM {{orders}}""",
    "hours": f"""
        SELECT CAST(event_id AS STRING) AS id, CAST(ts AS DATE) AS date, value / {_d(10)} AS duree_h, event_type AS poste FROM {{events}}""",
    "producers": f"""
        SELECT s_name AS nom, n_name AS commune, concat(CASE s_suppkey % 4 WHEN 0 THEN 'oeufs' WHEN 1 THEN 'miel' WHEN 2 THEN 'oeufs| miel' ELSE 'pain |miel' END,
            CASE WHEN s_suppkey % 5 = 0 THEN '|champignons' ELSE '' END) AS type_produit,
          {_coordinate(42, 's_suppkey * 3571 + 11', 9000)} AS latitude, {_coordinate(-4.5, 's_suppkey * 65537 + 29', 12000)} AS longitude
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey""",
}
_SOURCE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table of ``TEXTS``."""
    text = TEXTS[name]
    return spark.sql(text, **{source: table(spark, sf_dir, source) for source in set(_SOURCE.findall(text))})


def with_tables(*names: str) -> str:
    """WITH clause that defines the same domain tables for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({_SOURCE.sub(lambda m: m.group(1), TEXTS[n])})" for n in names)
