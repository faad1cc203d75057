"""Distances, boxes, radius joins, nearest points, polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from glebe.functions import geo
from glebe.functions.numbers import rounded, rounded_quickly
from glebe.operators import spatial
from glebe.plans import jobs
from queries.registry import query
from queries.standins import RADIUS_KM, SITE_LAT, SITE_LON, standin, table, with_tables


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


SITE_KM = km_sql(f"{SITE_LAT}::DOUBLE", f"{SITE_LON}::DOUBLE", "latitude", "longitude")


@query(with_tables("sales") + f" SELECT sale_id, round({SITE_KM}, 6) AS km FROM sales")
def distance_to_site(spark, sf):
    sales = spatial.with_distance(standin(spark, sf, "sales"), SITE_LAT, SITE_LON, decimals=6)
    return sales.select("sale_id", F.col("distance_km").alias("km"))


@query(with_tables("bare_parcels") + """ SELECT id, round(lon - 10.0::DOUBLE / (111.32::DOUBLE * cos(radians(lat))), 6) AS lon_min,
  round(lat - 10.0::DOUBLE / 111.32::DOUBLE, 6) AS lat_min, round(lon + 10.0::DOUBLE / (111.32::DOUBLE * cos(radians(lat))), 6) AS lon_max,
  round(lat + 10.0::DOUBLE / 111.32::DOUBLE, 6) AS lat_max FROM bare_parcels""")
def bounding_boxes(spark, sf):
    box = geo.bounding_box(F.col("lat"), F.col("lon"), 10.0)
    return standin(spark, sf, "bare_parcels").select("id", *(rounded(c, 6).alias(n) for n, c in box.items()))


@query(with_tables("sales") + f""" SELECT sale_id FROM sales WHERE latitude BETWEEN {SITE_LAT} - 100 / 111.32::DOUBLE AND {SITE_LAT} + 100 / 111.32::DOUBLE
  AND longitude BETWEEN {SITE_LON} - 100 / (111.32::DOUBLE * cos(radians({SITE_LAT}))) AND {SITE_LON} + 100 / (111.32::DOUBLE * cos(radians({SITE_LAT})))""")
def sales_in_box(spark, sf):
    return spatial.within_box(standin(spark, sf, "sales"), SITE_LAT, SITE_LON, 100).select("sale_id")


@query(with_tables("wells") + f" SELECT code_bss, round({SITE_KM}, 6) AS km FROM wells WHERE {SITE_KM} <= 200")
def wells_in_radius(spark, sf):
    near = spatial.within_radius(standin(spark, sf, "wells"), SITE_LAT, SITE_LON, 200)
    return near.select("code_bss", rounded("distance_km", 6).alias("km"))


PAIR_KM = km_sql("lat", "lon", "latitude", "longitude")


@query(with_tables("bare_parcels", "sales") + f""" SELECT id, sale_id, round({PAIR_KM}, 6) AS km FROM bare_parcels, sales
  WHERE latitude BETWEEN lat - 0.2 AND lat + 0.2 AND {PAIR_KM} <= {RADIUS_KM}""")
def sales_near_parcels(spark, sf):
    sales = standin(spark, sf, "sales").select("sale_id", "latitude", "longitude")
    pairs = spatial.radius_join(standin(spark, sf, "bare_parcels"), sales, RADIUS_KM)
    return pairs.select("id", "sale_id", rounded_quickly("distance_km", 6).alias("km"))


@query(with_tables("bare_parcels", "weather") + """, points AS (SELECT DISTINCT latitude, longitude FROM weather),
  ranked AS (SELECT *, pow(latitude - lat, 2) + pow(longitude - lon, 2) AS d FROM bare_parcels, points)
  SELECT id, latitude, longitude FROM ranked QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, latitude, longitude) = 1""")
def nearest_weather_point(spark, sf):
    points = standin(spark, sf, "weather").select("latitude", "longitude").distinct()
    return spatial.nearest(standin(spark, sf, "bare_parcels"), points, 1, "planar").select("id", "latitude", "longitude")


def _ranked_wells(n: int) -> str:
    return with_tables("bare_parcels", "wells") + f""", ranked AS (SELECT id, code_bss, {PAIR_KM} AS d FROM bare_parcels, wells)
      SELECT id, code_bss, round(d, 1) AS km, CAST(row_number() OVER (PARTITION BY id ORDER BY d, code_bss) AS INT) AS rang FROM ranked
      QUALIFY rang <= {n}"""


@query(_ranked_wells(1))
def nearest_station(spark, sf):
    found = spatial.nearest(standin(spark, sf, "bare_parcels"), standin(spark, sf, "wells"), 1, tie_break=["code_bss"])
    return found.select("id", "code_bss", rounded("distance", 1).alias("km"), F.col("rank").alias("rang"))


@query(_ranked_wells(3))
def three_nearest_stations(spark, sf):
    found = spatial.nearest(standin(spark, sf, "bare_parcels"), standin(spark, sf, "wells"), 3, tie_break=["code_bss"])
    return found.select("id", "code_bss", rounded("distance", 1).alias("km"), F.col("rank").alias("rang"))


@query(with_tables("wells") + f""" SELECT code_bss, nom_departement, round({SITE_KM}, 1) AS dist_km, profondeur_investigation AS prof_m, nb_mesures_piezo AS n_mesures
  FROM wells ORDER BY {SITE_KM}, code_bss LIMIT 15""")
def nearest_wells_listing(spark, sf):
    listed = spatial.nearest_listing(spatial.with_distance(standin(spark, sf, "wells"), SITE_LAT, SITE_LON), 15)
    return listed.select("code_bss", "nom_departement", rounded("distance_km", 1).alias("dist_km"),
                         F.col("profondeur_investigation").alias("prof_m"), F.col("nb_mesures_piezo").alias("n_mesures"))


@query(with_tables("wells") + f" SELECT code_bss, round({SITE_KM}, 2) AS distance_km FROM wells")
def wells_by_distance(spark, sf):
    return spatial.by_distance(spatial.with_distance(standin(spark, sf, "wells"), SITE_LAT, SITE_LON, decimals=2)).select("code_bss", "distance_km")


@query(with_tables("wells", "groundwater") + f""" SELECT mesure, code_bss, date_mesure FROM groundwater
  WHERE code_bss IN (SELECT code_bss FROM wells ORDER BY {SITE_KM}, code_bss LIMIT 10)""")
def measures_of_nearest_wells(spark, sf):
    wells = spatial.with_distance(standin(spark, sf, "wells"), SITE_LAT, SITE_LON)
    return jobs.measures_of_nearest(standin(spark, sf, "groundwater"), wells, 10).select("mesure", "code_bss", "date_mesure")


_ZONES_SQL = with_tables("bare_parcels") + """, zones AS (SELECT n_name AS zone, -4.0005::DOUBLE + n_nationkey % 5 * 2.4::DOUBLE AS x, 42.5003::DOUBLE + floor(n_nationkey / 5) * 1.8::DOUBLE AS y FROM nation)
  SELECT id, zone FROM {} LEFT JOIN zones ON lon > x AND lon < x + 2.0::DOUBLE AND lat > y AND lat - y < (lon - x) * 0.75::DOUBLE"""


def _triangles(spark, sf):
    x, y = F.col("x"), F.col("y")
    corners = F.array(F.array(x, y), F.array(x + 2.0, y), F.array(x + 2.0, y + 1.5), F.array(x, y))
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("zone"), (F.lit(-4.0005) + F.col("n_nationkey") % 5 * F.lit(2.4)).alias("x"),
        (F.lit(42.5003) + F.floor(F.col("n_nationkey") / 5) * F.lit(1.8)).alias("y"),
    ).select("zone", F.array(F.array(corners)).alias("shape"))


@query(_ZONES_SQL.format("bare_parcels"))
def parcels_in_triangular_zones(spark, sf):
    return spatial.points_in_zones(standin(spark, sf, "bare_parcels"), _triangles(spark, sf), "shape", "lat", "lon").select("id", "zone")


@query(_ZONES_SQL.format("(SELECT * FROM bare_parcels UNION ALL SELECT * FROM bare_parcels)"))
def repeated_parcels_in_zones(spark, sf):
    """Every point twice under one id."""
    parcels = standin(spark, sf, "bare_parcels")
    return spatial.points_in_zones(parcels.unionAll(parcels), _triangles(spark, sf), "shape", "lat", "lon").select("id", "zone")
