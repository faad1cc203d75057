"""Climate normals, comparable price, wells nearby, the enriched and ranked parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.operators import enrichment
from glebe.plans import jobs
from queries.registry import query
from queries.scoring import AXES_SQL, GLOBAL_SQL, rank_sql
from queries.spatial import PAIR_KM
from queries.standins import RADIUS_KM, standin, with_tables

WELL_KM = 40.0

NORMALS = """yearly AS (SELECT latitude, longitude, year(date) AS y, sum(precipitation_sum) AS rain, sum(et0_fao_evapotranspiration) AS etp,
    count(*) FILTER (WHERE temperature_2m_min < 0) AS frost FROM weather GROUP BY ALL),
  normals AS (SELECT latitude, longitude, round(avg(rain), 1) AS precip_mm, CAST(round(avg(frost), 0) AS INT) AS freeze_days, round(avg(etp), 1) AS etp_mm,
    count(*) AS n_years FROM yearly GROUP BY ALL)"""
PRICES = f"""usable AS (SELECT latitude, longitude, valeur_fonciere / (surface_terrain / 10000.0::DOUBLE) AS prix FROM sales
    WHERE valeur_fonciere IS NOT NULL AND surface_terrain > 0),
  prices AS (SELECT id, round(median(prix), 0) AS prix_ha, count(prix) AS n_sales FROM bare_parcels LEFT JOIN usable
    ON latitude BETWEEN lat - 0.2 AND lat + 0.2 AND {PAIR_KM} <= {RADIUS_KM} GROUP BY id)"""
WELLS = f"""near AS (SELECT id, count(code_bss) AS n_wells, round(min(CASE WHEN code_bss IS NOT NULL THEN {PAIR_KM} END), 6) AS nearest_km FROM bare_parcels LEFT JOIN wells
    ON latitude BETWEEN lat - 0.5 AND lat + 0.5 AND {PAIR_KM} <= {WELL_KM} GROUP BY id)"""
CLOSEST = """points AS (SELECT DISTINCT latitude, longitude FROM weather),
  closest AS (SELECT id, latitude, longitude FROM bare_parcels, points
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY pow(latitude - lat, 2) + pow(longitude - lon, 2), latitude, longitude) = 1),
  climate AS (SELECT id, latitude AS ref_latitude, longitude AS ref_longitude, precip_mm, freeze_days, etp_mm, n_years FROM closest JOIN normals USING (latitude, longitude))"""


@query(with_tables("weather") + ", " + NORMALS + " SELECT * FROM normals")
def climate_normals(spark, sf):
    return enrichment.climate_normals(standin(spark, sf, "weather"))


@query(with_tables("weather", "wells") + """ SELECT date, latitude, longitude, precipitation_sum FROM weather
  WHERE (latitude, longitude) IN (SELECT latitude, longitude FROM weather GROUP BY ALL HAVING count(*) >= 50)""")
def weather_of_known_points(spark, sf):
    weather = standin(spark, sf, "weather")
    known = weather.groupBy("latitude", "longitude").agg(F.count("*").alias("n")).filter("n >= 50")
    return enrichment.weather_of_points(weather, known).select("date", "latitude", "longitude", "precipitation_sum")


@query(with_tables("sales") + " SELECT * FROM sales WHERE valeur_fonciere IS NOT NULL AND surface_terrain > 0")
def usable_sales(spark, sf):
    return enrichment.usable_sales(standin(spark, sf, "sales"))


@query(with_tables("bare_parcels", "sales") + ", " + PRICES + " SELECT * FROM prices")
def comparable_price_in_radius(spark, sf):
    return enrichment.comparable_price(standin(spark, sf, "bare_parcels"), standin(spark, sf, "sales"), RADIUS_KM)


@query(with_tables("bare_parcels", "wells") + ", " + WELLS + " SELECT * FROM near")
def wells_near_parcels(spark, sf):
    near = enrichment.wells_nearby(standin(spark, sf, "bare_parcels"), standin(spark, sf, "wells"), WELL_KM)
    return near.withColumn("nearest_km", rounded("nearest_km", 6))


def _enriched(spark, sf, overwrite):
    return enrichment.enrich(standin(spark, sf, "parcels"), standin(spark, sf, "weather"), standin(spark, sf, "sales"),
                             standin(spark, sf, "wells"), overwrite, RADIUS_KM, WELL_KM)


ALL_CONTEXT = with_tables("parcels", "bare_parcels", "weather", "sales", "wells") + f", {NORMALS}, {CLOSEST}, {PRICES}, {WELLS}"
JOINED = "parcels LEFT JOIN climate USING (id) LEFT JOIN prices USING (id) LEFT JOIN near USING (id)"


@query(ALL_CONTEXT + f""" SELECT id, coalesce(meteo_precip_annuelle_mm, precip_mm) AS meteo_precip_annuelle_mm, coalesce(meteo_jours_gel, freeze_days) AS meteo_jours_gel,
  coalesce(meteo_etp_annuelle_mm, etp_mm) AS meteo_etp_annuelle_mm, coalesce(prix_comparable_eur_ha, prix_ha) AS prix_comparable_eur_ha,
  CAST(n_wells AS INT) AS forages_brgm_count FROM {JOINED}""")
def enriched_parcels(spark, sf):
    return _enriched(spark, sf, False).select("id", "meteo_precip_annuelle_mm", "meteo_jours_gel", "meteo_etp_annuelle_mm",
                                              "prix_comparable_eur_ha", "forages_brgm_count")


_TWICE = "(SELECT * FROM parcels UNION ALL SELECT * FROM parcels) AS parcels" + JOINED.removeprefix("parcels")


@query(ALL_CONTEXT + f""" SELECT id, coalesce(meteo_precip_annuelle_mm, precip_mm) AS meteo_precip_annuelle_mm, coalesce(prix_comparable_eur_ha, prix_ha) AS prix_comparable_eur_ha,
  CAST(n_wells AS INT) AS forages_brgm_count FROM {_TWICE}""")
def enriched_repeated_parcels(spark, sf):
    """Every parcel twice under one id."""
    parcels = standin(spark, sf, "parcels")
    out = enrichment.enrich(parcels.unionAll(parcels), standin(spark, sf, "weather"), standin(spark, sf, "sales"), standin(spark, sf, "wells"),
                            False, RADIUS_KM, WELL_KM)
    return out.select("id", "meteo_precip_annuelle_mm", "prix_comparable_eur_ha", "forages_brgm_count")


@query(ALL_CONTEXT + f""" SELECT id, CAST(n_years AS INT) AS weather_years, ref_latitude AS weather_latitude, ref_longitude AS weather_longitude,
  CAST(n_sales AS INT) AS dvf_transactions, CAST(n_wells AS INT) AS bss_stations, nearest_km AS nearest_bss_km,
  CASE WHEN prix_ha IS NULL THEN '{enrichment.NO_SALE}' ELSE '' END AS warnings FROM {JOINED}""")
def enrichment_diagnostics(spark, sf):
    out = _enriched(spark, sf, True).select("id", "diagnostics.*")
    return out.withColumns({"warnings": F.array_join("warnings", "; "), "nearest_bss_km": rounded("nearest_bss_km", 6)})


@query(ALL_CONTEXT + f""", filled AS (SELECT parcels.* REPLACE (coalesce(meteo_precip_annuelle_mm, precip_mm) AS meteo_precip_annuelle_mm,
    coalesce(meteo_jours_gel, freeze_days) AS meteo_jours_gel, coalesce(prix_comparable_eur_ha, prix_ha) AS prix_comparable_eur_ha) FROM {JOINED}
    WHERE coalesce(prix_achat, 0) >= 0),
  {AXES_SQL.replace('FROM parcels', 'FROM filled')}, scored AS (SELECT *, {GLOBAL_SQL} AS score_global FROM axes)
  SELECT id, score_economique, score_eau, score_topographie, score_global, {rank_sql()} AS rang,
    CASE WHEN score_global >= 70 THEN 'Favorable' WHEN score_global >= 45 THEN 'Mitigé' ELSE 'Défavorable' END AS mention FROM scored""")
def ranked_parcels(spark, sf):
    ranked, _ = jobs.evaluate_parcels(
        standin(spark, sf, "parcels"), standin(spark, sf, "weather"), standin(spark, sf, "sales"), standin(spark, sf, "wells"),
        sale_radius_km=RADIUS_KM, well_radius_km=WELL_KM)
    return ranked.select("id", "score_economique", "score_eau", "score_topographie", "score_global", "rang", "mention")
