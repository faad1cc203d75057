"""Lenient values: numbers, dates, durations, labels, file names, JSON fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glebe.functions import dates, text
from glebe.functions.numbers import rounded
from glebe.operators import conform, hours
from glebe.schemas import CROP_LABELS
from queries.registry import query
from queries.standins import standin, table, with_tables


@query("""SELECT o_orderkey, o_totalprice AS virgule, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS espace, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS INT) END AS entier FROM orders""")
def decimal_comma_numbers(spark, sf):
    price, key = F.col("o_totalprice").cast("string"), F.col("o_orderkey")
    comma = F.replace(price, F.lit("."), F.lit(","))
    spaced = F.when(key % 5 == 0, F.lit("n.d.")).otherwise(F.concat(F.substring(comma, 1, 1), F.lit("  "), F.substring(comma, 2, 40)))
    whole = F.when(key % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".7")))
    return table(spark, sf, "orders").select("o_orderkey", text.decimal_comma_number(comma).alias("virgule"),
                                             text.decimal_comma_number(spaced).alias("espace"), text.lenient_int(whole).alias("entier"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) * 1000 AS milliers, o_totalprice AS virgule FROM orders""")
def french_numbers(spark, sf):
    thousands = F.format_number(F.floor("o_totalprice") * 1000, 0)
    comma = F.concat(F.lit(" "), F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")), F.lit(" "))
    return table(spark, sf, "orders").select("o_orderkey", text.french_number(thousands).alias("milliers"), text.french_number(comma).alias("virgule"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS iso, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS jour,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS cotation FROM orders""")
def lenient_dates(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    iso = F.when(key % 10 == 0, F.lit("pas-une-date")).when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    slash = F.when(key % 10 == 0, F.lit("31/31/2000")).when(key % 2 == 0, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    quote = F.when(key % 10 == 0, F.lit("?")).when(key % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", dates.iso_date(iso).alias("iso"), dates.slash_date(slash).alias("jour"), dates.quote_date(quote).alias("cotation"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS annee, CAST(month(o_orderdate) AS INT) AS mois, CAST(week(o_orderdate) AS INT) AS semaine,
  CAST(isodow(o_orderdate) AS INT) AS jour_semaine, CAST(date_trunc('week', o_orderdate) AS DATE) AS lundi, CAST(date_trunc('month', o_orderdate) AS DATE) AS debut_mois,
  make_date(CAST(year(o_orderdate) AS INT) - 4, 1, 1) AS debut_historique FROM orders""")
def date_parts(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", *(c.alias(n) for n, c in dates.date_parts(day).items()), dates.period_start(day, "week").alias("lundi"),
        dates.period_start(day, "month").alias("debut_mois"), dates.backfill_start(day, 5).alias("debut_historique"))


DURATION_KINDS = 7


@query(f"""SELECT event_id, round(CASE event_id % {DURATION_KINDS} WHEN 0 THEN event_id % 9 + (event_id % 60) / 60.0::DOUBLE WHEN 1 THEN event_id % 9 + (event_id % 60) / 60.0::DOUBLE
  WHEN 2 THEN event_id % 9 + 0.5 WHEN 3 THEN event_id % 9 WHEN 4 THEN (event_id % 500) / 60.0::DOUBLE WHEN 5 THEN (event_id % 500) / 60.0::DOUBLE END, 4) AS heures FROM events""")
def durations(spark, sf):
    i = F.col("event_id")
    h, m = (i % 9).cast("string"), (i % 60).cast("string")
    form = i % DURATION_KINDS
    t = (F.when(form == 0, F.concat(h, F.lit("h"), m)).when(form == 1, F.concat(h, F.lit("H"), m, F.lit("m"))).when(form == 2, F.concat(h, F.lit(".5h")))
         .when(form == 3, F.concat(F.lit(" "), h, F.lit("h"))).when(form == 4, F.concat((i % 500).cast("string"), F.lit("MIN")))
         .when(form == 5, F.concat((i % 500).cast("string"), F.lit("m"))).otherwise(F.concat(h, F.lit(" heures"))))
    return table(spark, sf, "events").select("event_id", rounded(dates.duration_hours(t), 4).alias("heures"))


WEEKDAYS = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS ref, event_id % 13 AS k, (isodow(ts) - 1 - event_id % 13 + 7) % 7 AS back FROM events)
  SELECT event_id, CASE WHEN k < 7 THEN ref - CAST(CASE WHEN back = 0 THEN 7 ELSE back END AS INT) WHEN k = 7 THEN ref - 1 WHEN k = 8 THEN ref WHEN k = 9 THEN ref WHEN k = 10 THEN ref - 3
    WHEN k = 11 THEN ref - 3 END AS jour FROM e""")
def relative_dates(spark, sf):
    k, ref = F.col("event_id") % 13, F.col("ts").cast("date")
    t = F.when(k == 7, "hier").when(k == 8, "Aujourd'hui").when(k == 9, " auj ").when(k == 10, F.date_sub(ref, 3).cast("string")).when(
        k == 11, F.date_format(F.date_sub(ref, 3), "dd/MM/yyyy")).when(k == 12, "demain")
    for i, name in enumerate(WEEKDAYS):
        t = t.when(k == i, name.capitalize())
    return table(spark, sf, "events").select("event_id", dates.relative_date(t, ref).alias("jour"))


@query("""WITH e AS (SELECT CAST(event_id AS STRING) AS id, event_type AS poste, event_id % 4 AS k, event_id FROM events)
  SELECT id, poste, CASE k WHEN 0 THEN DATE '2026-03-31' WHEN 1 THEN DATE '2026-04-01' WHEN 2 THEN DATE '2026-03-30' END AS date, CASE WHEN event_id % 5 <> 0 THEN round((event_id % 500) / 60.0::DOUBLE, 2) END AS duree_h,
    CASE WHEN event_id % 5 = 0 THEN 'duree' WHEN k = 3 THEN 'jour' END AS error FROM e""")
def manual_entries(spark, sf):
    i = F.col("event_id")
    asked = table(spark, sf, "events").select(
        i.cast("string").alias("id"), F.col("event_type").alias("poste"), F.lit(None).cast("string").alias("notes"),
        F.when(i % 5 == 0, "longtemps").otherwise(F.concat((i % 500).cast("string"), F.lit("min"))).alias("duree"),
        F.when(i % 4 == 0, "hier").when(i % 4 == 1, "").when(i % 4 == 2, "lundi").otherwise("plus tard").alias("jour"))
    return hours.entries_from_text(asked, dt.date(2026, 4, 1)).select("id", "poste", "date", "duree_h", "error")


@query("""WITH e AS (SELECT user_id AS worker, ts, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'stop' ELSE 'start' END AS kind FROM events),
  p AS (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt FROM e WINDOW w AS (PARTITION BY worker ORDER BY ts, kind, event_type))
  SELECT worker, event_type AS poste, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS debut, strftime(nt, '%H:%M') AS fin,
    floor(date_diff('microsecond', ts, nt) / 1000000)::BIGINT AS secondes FROM p WHERE kind = 'start' AND nk = 'stop'""")
def timer_pairs(spark, sf):
    events = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_id") % 3 == 0, "stop").otherwise("start"))
    pairs = hours.hours_from_timer(events, worker="user_id", task="event_type", seconds=True)
    return pairs.select(F.col("user_id").alias("worker"), "poste", "date", "debut", "fin", "secondes")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(2000 + p_partkey % 60 AS INT) WHEN p_partkey % 4 = 1 THEN CAST(2010 + p_partkey % 90 AS INT) END AS annee_cotation,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(2000 + p_partkey % 60 AS INT) END AS annee, CAST(CASE p_partkey % 5 WHEN 4 THEN NULL WHEN 3 THEN 1 ELSE 1 + p_partkey % 4 END AS INT) AS trimestre FROM part""")
def years_and_quarters_of_names(spark, sf):
    i = F.col("p_partkey")
    year = F.when(i % 4 == 0, F.concat(F.lit("COD_"), (2000 + i % 60).cast("string"), F.lit("_x"))).when(
        i % 4 == 1, F.concat(F.lit("COD-A"), (10 + i % 90).cast("string"), F.lit("-x"))).otherwise(F.concat(F.lit("n"), (12000 + i % 999).cast("string")))
    q = (1 + i % 4).cast("string")
    quarter = F.when(i % 5 == 0, F.concat(F.lit("DVF T"), q)).when(i % 5 == 1, F.concat(F.lit("DVF q"), q)).when(
        i % 5 == 2, F.concat(q, F.lit("ème trimesdre "), q, F.lit("ème trimestre"))).when(i % 5 == 3, "1er trimestre").otherwise("DVF")
    return table(spark, sf, "part").select("p_partkey", text.quote_file_year(year).alias("annee_cotation"), text.year_in_text(year).alias("annee"),
                                           text.quarter_in_text(quarter).alias("trimestre"))


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '…') ELSE text END AS court, substr(text, 1, 35) AS coupe,
  split_part(text, ' ', 1) AS premier, ltrim(CAST(doc_id % 100 AS STRING), '0') AS departement, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source) AS premier_non_vide FROM documents""")
def short_labels(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.short_label(t, 40).alias("court"), F.substring(t, 1, 35).alias("coupe"), text.first_word(t).alias("premier"),
        text.clean_department(F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0")).alias("departement"),
        text.first_non_empty(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("premier_non_vide"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_id % 3 <> 0 THEN event_type END AS premier FROM events""")
def json_fields_and_first_items(spark, sf):
    items = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("autre")))
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), text.first_item(items).alias("premier"))


_CODES = ", ".join(f"('{k}', '{v}')" for k, v in CROP_LABELS.items())


@query(with_tables("crops") + f", codes(code, label) AS (VALUES {_CODES}) SELECT id_parcel, coalesce(label, 'Inconnu') AS libelle_culture FROM crops LEFT JOIN codes ON code = code_culture")
def crop_labels(spark, sf):
    return standin(spark, sf, "crops").select("id_parcel", conform.crop_label(F.col("code_culture")).alias("libelle_culture"))


@query("SELECT s_suppkey, coalesce(n_name, 'Inconnu') AS nom FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON s_nationkey = n_nationkey")
def labels_by_join(spark, sf):
    """A third of the labels has no code, so that some suppliers find none."""
    code = F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey"))
    nations = table(spark, sf, "nation").select(code.alias("s_nationkey"), F.col("n_name").alias("nom"))
    return conform.with_label(table(spark, sf, "supplier"), nations, "s_nationkey", "nom", "Inconnu").select("s_suppkey", "nom")


@query("""SELECT CAST(c_custkey AS DOUBLE) AS cle, c_name AS nom, NULL::DOUBLE AS solde FROM customer UNION ALL SELECT s_suppkey::DOUBLE, NULL, s_acctbal FROM supplier""")
def rows_of_both_tables(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("cle"), F.col("c_name").alias("nom"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("double").alias("cle"), F.col("s_acctbal").alias("solde"))
    return conform.concat([a, b], relaxed=True)


@query("SELECT event_id, CAST(ts AS DATE) AS date, 42.5::DOUBLE AS latitude, -1.5::DOUBLE AS longitude, round(value * 0.36::DOUBLE, 2) AS wind_speed_10m_max FROM events WHERE event_id % 10 <> 0 "
       "UNION ALL SELECT event_id, CAST(ts AS DATE), 42.5::DOUBLE, -1.5::DOUBLE, NULL FROM events WHERE event_id % 10 = 0")
def placed_station_measures(spark, sf):
    raw = {f: F.lit(None).cast("string") for f in ("TX", "TN", "TM", "RR", "ETP", "INST")}
    raw["FFM"] = F.when(F.col("event_id") % 10 == 0, "-9999").otherwise(F.col("value").cast("string"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("date"), *conform.station_measures(raw))
    return conform.place_constant(rows, 42.5, -1.5).select("event_id", "date", "latitude", "longitude", "wind_speed_10m_max")
