"""Weather tables: merge, refresh plan, stored years, streams, display."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.operators import conform, filters, latest, market_gap, summaries
from glebe.plans import jobs
from glebe.schemas import GRID_MEASURES
from glebe.session import scratch_path
from glebe.sources import records, tables
from glebe.streaming.weather import stream_weather
from queries.registry import query
from queries.standins import standin, table, with_tables

WEATHER = with_tables("weather")
END = dt.date(2024, 2, 15)


def _slices(weather):
    """An older and a newer, partly corrected part of the table that overlap."""
    old = weather.filter("date < '2024-01-20'")
    new = weather.filter("date >= '2024-01-10'").withColumn("temperature_2m_max", F.col("temperature_2m_max") + 1)
    return old, new.withColumn("precipitation_sum", F.when(F.dayofmonth("date") != 12, F.col("precipitation_sum")))


MERGED = """merged AS (SELECT date, latitude, longitude, CASE WHEN date >= DATE '2024-01-10' THEN temperature_2m_max + 1 ELSE temperature_2m_max END AS temperature_2m_max,
  CASE WHEN date >= DATE '2024-01-10' AND day(date) = 12 THEN NULL ELSE precipitation_sum END AS precipitation_sum FROM weather)"""


@query(WEATHER + """ SELECT min(date) AS premiere_date, max(date) AS derniere_date, count(*) AS n_jours, round(avg(temperature_2m_max), 1) AS tmax_moy_c,
  round(avg(temperature_2m_min), 1) AS tmin_moy_c, round(sum(precipitation_sum), 0) AS pluie_totale_mm FROM weather""")
def weather_summary(spark, sf):
    return summaries.weather_summary(standin(spark, sf, "weather"))


@query(WEATHER + f", {MERGED} SELECT * FROM merged")
def merged_weather(spark, sf):
    old, new = _slices(standin(spark, sf, "weather").select("date", "latitude", "longitude", "temperature_2m_max", "precipitation_sum"))
    return latest.upsert(old, new)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_event_per_user(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return latest.keep_latest(events, ["user_id"], F.struct("ts", "event_id")).drop("ts")


@query(WEATHER + """, wanted AS (SELECT DISTINCT latitude, longitude FROM weather), known AS (SELECT latitude, longitude, max(date) AS d FROM weather WHERE latitude < 46 GROUP BY ALL)
  SELECT latitude, longitude, CASE WHEN d IS NULL THEN DATE '2020-01-01' ELSE greatest(DATE '2020-01-01', d - 30) END AS debut, DATE '2024-02-15' AS fin,
    CASE WHEN d IS NULL THEN 'full' ELSE 'incremental' END AS mode, FALSE AS a_jour FROM wanted LEFT JOIN known USING (latitude, longitude)""")
def refresh_plan(spark, sf):
    """Points from the 46th degree on are not stored yet, so that both modes occur."""
    weather = standin(spark, sf, "weather")
    return latest.refresh_plan(weather.select("latitude", "longitude").distinct(), weather.filter("latitude < 46"), END)


@query(WEATHER + f", {MERGED} SELECT year(date)::INT AS annee, * FROM merged WHERE date BETWEEN DATE '2023-01-05' AND DATE '2024-01-15'")
def stored_weather_in_range(spark, sf):
    old, new = _slices(standin(spark, sf, "weather").select("date", "latitude", "longitude", "temperature_2m_max", "precipitation_sum"))
    path = scratch_path(spark, "weather")
    tables.upsert_table(spark, path, old, latest.WEATHER_KEYS)
    tables.upsert_table(spark, path, new, latest.WEATHER_KEYS)
    stored = tables.read_table(spark, path)
    return filters.date_range(stored, dt.date(2023, 1, 5), dt.date(2024, 1, 15))


def landed_payloads(spark, weather) -> str:
    """Weather written as one JSON payload per point and year, plus payloads without days."""
    day = F.struct(F.col("date").cast("string").alias("time"), *GRID_MEASURES)
    points = weather.groupBy("latitude", "longitude", F.year("date").alias("_y")).agg(F.sort_array(F.collect_list(day)).alias("d"))
    daily = F.struct(*(F.col("d")[c].alias(c) for c in ("time", *GRID_MEASURES)))
    good = points.select(F.to_json(F.struct("latitude", "longitude", daily.alias("daily"))).alias("value"))
    empty = points.select(F.to_json(F.struct("latitude", "longitude")).alias("value"))
    path = scratch_path(spark, "payloads")
    good.unionByName(empty).write.text(path)
    return path


MEASURES = ", ".join(f"round({m}, 6) AS {m}" for m in GRID_MEASURES)


@query(WEATHER + f" SELECT date, latitude, longitude, {MEASURES} FROM weather")
def weather_from_payloads(spark, sf):
    rows, _ = records.read_weather(spark, landed_payloads(spark, standin(spark, sf, "weather")))
    return rows.withColumns({m: rounded(m, 6) for m in GRID_MEASURES})


@query(WEATHER + " SELECT latitude, count(DISTINCT year(date)) AS n FROM weather GROUP BY latitude")
def rejected_payloads(spark, sf):
    _, rejected = records.read_weather(spark, landed_payloads(spark, standin(spark, sf, "weather")))
    return rejected.groupBy("latitude").agg(F.count("*").alias("n"))


@query(WEATHER + f" SELECT date, latitude, longitude, {MEASURES} FROM weather")
def streamed_weather(spark, sf):
    landing, store, marks = landed_payloads(spark, standin(spark, sf, "weather")), scratch_path(spark, "streamed"), scratch_path(spark, "marks")
    # All years are sent at once per point, so nothing falls behind the lookback.
    stream_weather(spark, landing, store, marks, lookback_days=1100).awaitTermination()
    return tables.read_table(spark, store).select("date", "latitude", "longitude", *(rounded(m, 6).alias(m) for m in GRID_MEASURES))


@query(WEATHER + """ SELECT min(date) AS premiere_date, max(date) AS derniere_date, count(*) AS n_jours, round(avg(temperature_2m_max), 1) AS tmax_moy_c,
  round(avg(temperature_2m_min), 1) AS tmin_moy_c, round(sum(precipitation_sum), 0) AS pluie_totale_mm FROM weather WHERE date BETWEEN DATE '2023-01-01' AND DATE '2024-02-15'""")
def refreshed_weather_job(spark, sf):
    weather = standin(spark, sf, "weather")
    return jobs.refresh_weather(spark, landed_payloads(spark, weather), scratch_path(spark, "grid"),
                                weather.select("latitude", "longitude").distinct(), END, backfill_years=2)


_TWICE = """, taken AS (SELECT * FROM weather WHERE date >= DATE '{first}'),
  known AS (SELECT latitude, longitude, max(date) AS last FROM taken WHERE date <= DATE '2023-12-31' GROUP BY ALL)
  SELECT date, latitude, round(CASE WHEN last IS NULL OR date >= last - 30 THEN temperature_2m_max + 1 ELSE temperature_2m_max END, 6) AS temperature_2m_max
  FROM taken LEFT JOIN known USING (latitude, longitude)"""


def _two_deliveries(spark, sf):
    """All days up to New Year's Eve, then all days again, a degree warmer."""
    weather = standin(spark, sf, "weather")
    first = landed_payloads(spark, weather.filter("date <= '2023-12-31'"))
    second = landed_payloads(spark, weather.withColumn("temperature_2m_max", F.col("temperature_2m_max") + 1))
    return weather, first, second


@query(WEATHER + _TWICE.format(first="2023-01-01") + " WHERE date <= DATE '2024-02-15'")
def weather_refreshed_twice(spark, sf):
    """A first load and an incremental one, which only takes what its lookback covers."""
    weather, first, second = _two_deliveries(spark, sf)
    points, path = weather.select("latitude", "longitude").distinct(), scratch_path(spark, "grid")
    jobs.refresh_weather(spark, first, path, points, END, backfill_years=2)
    jobs.refresh_weather(spark, second, path, points, END, backfill_years=2)
    return tables.read_table(spark, path).select("date", "latitude", rounded("temperature_2m_max", 6).alias("temperature_2m_max"))


@query(WEATHER + _TWICE.format(first="1900-01-01"))
def weather_streamed_twice(spark, sf):
    """A second batch whose rows before the lookback are refused."""
    _, first, second = _two_deliveries(spark, sf)
    store, marks, landing = scratch_path(spark, "streamed"), scratch_path(spark, "marks"), scratch_path(spark, "landing")
    for delivery in (first, second):
        spark.read.text(delivery).write.mode("append").text(landing)
        stream_weather(spark, landing, store, marks, lookback_days=30).awaitTermination()
    return tables.read_table(spark, store).select("date", "latitude", rounded("temperature_2m_max", 6).alias("temperature_2m_max"))


@query(WEATHER + f", {MERGED} SELECT * FROM merged")
def merged_into_repeated_keys(spark, sf):
    """A stored table that holds every key twice."""
    old, new = _slices(standin(spark, sf, "weather").select("date", "latitude", "longitude", "temperature_2m_max", "precipitation_sum"))
    path = scratch_path(spark, "repeated")
    tables.write_years(old.unionAll(old).withColumn("annee", F.year("date")), path)
    # A batch that touches every year of the table.
    tables.upsert_table(spark, path, new.unionByName(old.groupBy(F.year("date").alias("_y"), "latitude", "longitude").agg(
        F.min_by(F.struct(*old.columns), "date").alias("r")).select("r.*")), latest.WEATHER_KEYS)
    return tables.read_table(spark, path).drop("annee")


# Raw station fields the records are written with, and the factor back from project units.
RAW = {"TX": "temperature_2m_max", "TN": "temperature_2m_min", "RR": "precipitation_sum"}


def landed_station_records(spark, sf) -> str:
    """Observations of one station per user: whole tenths, a sentinel, and date keys that vary."""
    events = table(spark, sf, "events")
    tenths = F.floor(F.col("value"))
    text = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_id") % 3
    record = F.struct(
        F.col("user_id").cast("string").alias("station"),
        F.when(kind == 0, F.concat(text, F.lit("T06:00:00Z"))).alias("reference_time"),
        F.when(kind == 1, text).alias("DATE"),
        tenths.alias("TX"),
        F.when(F.col("event_id") % 10 == 0, F.lit(-9999)).otherwise(tenths - 50).alias("TN"),
        F.when(F.col("event_id") % 7 == 0, F.lit("-9999")).otherwise(tenths.cast("string")).alias("FFM"),
        F.col("event_id").alias("no"),
    )
    path = scratch_path(spark, "observations")
    events.select(F.to_json(record).alias("value")).write.text(path)
    return path


STATION = """obs AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, round(floor(value) * 0.1, 2) AS temperature_2m_max,
  CASE WHEN event_id % 10 <> 0 THEN round((floor(value) - 50) * 0.1, 2) END AS temperature_2m_min,
  CASE WHEN event_id % 7 <> 0 THEN round(floor(value) * 0.36, 2) END AS wind_speed_10m_max FROM events WHERE event_id % 3 <> 2)"""


@query(f"WITH {STATION} SELECT CAST(event_id AS STRING) AS no, date, temperature_2m_max, temperature_2m_min, wind_speed_10m_max FROM obs")
def station_records(spark, sf):
    rows = records.read_station_records(spark, landed_station_records(spark, sf), keep=("no",))
    return rows.select("no", "date", "temperature_2m_max", "temperature_2m_min", "wind_speed_10m_max")


STATIONS = """stations AS (SELECT CAST(user_id AS STRING) AS station, 42.0 + ((user_id * 611) % 9000) / 1000.0::DOUBLE AS latitude, -4.5 + ((user_id * 937) % 12000) / 1000.0::DOUBLE AS longitude
  FROM (SELECT DISTINCT user_id FROM events))"""


@query(with_tables("bare_parcels") + f""", {STATION}, {STATIONS},
  chosen AS (SELECT DISTINCT station, latitude, longitude FROM (SELECT station, latitude, longitude FROM bare_parcels, stations
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude))
      * pow(sin(radians(longitude - lon) / 2), 2))), station) = 1)),
  days AS (SELECT DISTINCT latitude, longitude, date FROM obs JOIN chosen ON station = CAST(user_id AS STRING) WHERE date >= DATE '2024-01-01')
  SELECT min(date) AS premiere_date, max(date) AS derniere_date, count(*) AS n_jours FROM days""")
def refreshed_station_job(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    stations = users.select(F.to_json(F.struct(
        F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("id"), F.when(F.col("user_id") % 2 == 1, F.col("user_id").cast("string")).alias("id_station"),
        (F.lit(42.0) + (F.col("user_id") * 611) % 9000 / F.lit(1000.0)).alias("lat"), (F.lit(-4.5) + (F.col("user_id") * 937) % 12000 / F.lit(1000.0)).alias("Longitude"))).alias("value"))
    path = scratch_path(spark, "stations")
    stations.write.text(path)
    out = jobs.refresh_station_weather(spark, path, landed_station_records(spark, sf), scratch_path(spark, "station"), standin(spark, sf, "bare_parcels"),
                                       dt.date(2024, 2, 15), backfill_years=1, stations_layout="lines")
    return out.select("premiere_date", "derniere_date", "n_jours")


@query(WEATHER + """ SELECT date, 'grille' AS source, round(sum(pluie_mm), 3) AS pluie_mm, round(sum(rayonnement_mj), 3) AS rayonnement_mj, CAST(NULL AS DOUBLE) AS ensoleillement_min
    FROM (SELECT date, precipitation_sum AS pluie_mm, shortwave_radiation_sum AS rayonnement_mj FROM weather WHERE date >= DATE '2023-06-01') GROUP BY date
  UNION ALL SELECT date, 'station', round(sum(precipitation_sum), 3), NULL, round(sum(wind_speed_10m_max), 3) FROM weather WHERE date >= DATE '2023-06-01' GROUP BY date""")
def weather_of_both_sources(spark, sf):
    grid = standin(spark, sf, "weather")
    station = grid.select("date", "precipitation_sum", F.col("wind_speed_10m_max").alias("sunshine_duration_min"))
    shown = jobs.weather_series(grid, station, start=dt.date(2023, 6, 1))
    return shown.groupBy("date", "source").agg(
        *(rounded(F.sum(c), 3).alias(c) for c in ("pluie_mm", "rayonnement_mj", "ensoleillement_min")))


@query(WEATHER + " SELECT date, t_max, etp_mm FROM (SELECT date, round(temperature_2m_max, 6) AS t_max, round(et0_fao_evapotranspiration, 6) AS etp_mm FROM weather)")
def displayed_weather(spark, sf):
    shown = conform.display_weather(standin(spark, sf, "weather"))
    return shown.select("date", rounded("t_max", 6).alias("t_max"), rounded("etp_mm", 6).alias("etp_mm"))


@query(WEATHER + " SELECT min(date) AS date_min, max(date) AS date_max FROM weather")
def weather_date_span(spark, sf):
    return summaries.date_span(standin(spark, sf, "weather"))


@query(WEATHER + """ SELECT latitude, longitude, CAST(date_trunc('month', date) AS DATE) AS periode, round(sum(precipitation_sum), 1) AS pluie_mm,
  round(sum(et0_fao_evapotranspiration), 1) AS etp_mm, round(sum(precipitation_sum) - sum(et0_fao_evapotranspiration), 1) AS bilan_mm FROM weather GROUP BY ALL""")
def water_balance(spark, sf):
    return market_gap.water_balance(standin(spark, sf, "weather"))
