"""Readers: the tables are first landed as CSV, JSON or ZIP, with drifting headers and number formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glebe.functions import geo
from glebe.functions.numbers import rounded
from glebe.operators import filters, hours
from glebe.operators.conform import conform_quotes, conform_sales, fill_quote_year, fill_sale_period
from glebe.plans import jobs
from glebe.schemas import CROP_LABELS, LAND_SALES, STRING, struct
from glebe.session import scratch_path
from glebe.sources import archives, landing, records, tables
from queries.registry import query
from queries.spatial import SITE_KM
from queries.standins import SITE_LAT, SITE_LON, standin, table, with_tables


def _comma(c: str):
    return F.coalesce(F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")), F.lit("nd"))


def landed_quotes(spark, sf) -> str:
    """Three dialects: current names with ";" and decimal commas, old names with "," in Latin-1, no year."""
    quotes = standin(spark, sf, "quotes")
    path = scratch_path(spark, "quotes")
    week = (F.col("annee") % 53).cast("string")
    current = quotes.filter("annee % 2 = 0 AND marche <> 'MARCHE 0'").select(
        "annee", week.alias("semaine"), F.col("date").alias("date_cotation"), F.col("produit").alias("produit_libelle"),
        F.col("marche").alias("marche_libelle"), F.col("stade").alias("stade_libelle"), "unite",
        _comma("prix_min").alias("prix_min"), _comma("prix_max").alias("prix_max"), _comma("prix_moyen").alias("prix_moyen"))
    old = quotes.filter("annee % 2 = 1 AND marche <> 'MARCHE 0'").select(
        F.col("annee").alias("Annee"), week.alias("Semaine"), F.col("date").alias("DateDebut"), F.col("produit").alias("Produit"),
        F.col("marche").alias("Marche"), F.col("stade").alias("Stade"), F.lit("é").alias("catégorie"), F.col("unite").alias("Unité"),
        F.col("prix_min").alias("Prix Min"), F.col("prix_max").alias("Prix Max"), F.col("prix_moyen").alias("Prix Moyen"))
    no_year = quotes.filter("marche = 'MARCHE 0'").select(
        "date", week.alias("semaine"), "produit", "marche", "stade", "unite", F.col("prix_min").alias("min"), F.col("prix_max").alias("max"),
        F.col("prix_moyen").alias("moyen"))
    current.write.option("header", True).option("sep", ";").csv(f"{path}/current")
    old.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/old")
    no_year.write.option("header", True).option("sep", ";").csv(f"{path}/no_year")
    return f"{path}/*"


QUOTES = with_tables("quotes") + """, landed AS (SELECT annee, CAST(annee % 53 AS INT) AS semaine, date, produit, marche, stade,
  CASE WHEN annee % 2 = 1 AND marche <> 'MARCHE 0' THEN 'é' END AS categorie, unite, prix_min, prix_max, prix_moyen FROM quotes)"""
QUOTE_COLUMNS = ["annee", "semaine", "date", "produit", "marche", "stade", "categorie", "unite", "prix_min", "prix_max", "prix_moyen"]


def _read_quotes(spark, path):
    """Part files carry no year in their names, so only the dates can give a missing year."""
    rows = landing.read_csv_files(spark, landing.quote_manifest(spark, path), conform_quotes)
    return fill_quote_year(rows.withColumn("_file_year", F.lit(None).cast("int")))


@query(QUOTES + " SELECT * FROM landed")
def quotes_from_csv(spark, sf):
    return _read_quotes(spark, landed_quotes(spark, sf)).select(QUOTE_COLUMNS)


@query(QUOTES + """, dialects(kind, separateur, encodage, entete, format) AS (VALUES ('even', ';', 'UTF-8', 'annee;semaine;date_cotation;produit_libelle;marche_libelle;stade_libelle;unite;prix_min;prix_max;prix_moyen', 'CSV'),
  ('odd', ',', 'ISO-8859-1', 'Annee,Semaine,DateDebut,Produit,Marche,Stade,catégorie,Unité,Prix Min,Prix Max,Prix Moyen', 'CSV'),
  ('none', ';', 'UTF-8', 'date;semaine;produit;marche;stade;unite;min;max;moyen', 'CSV'))
  SELECT separateur, encodage, entete, format, count(*) AS n FROM landed JOIN dialects ON kind = CASE WHEN marche = 'MARCHE 0' THEN 'none' WHEN annee % 2 = 1 THEN 'odd' ELSE 'even' END GROUP BY ALL""")
def quote_file_dialects(spark, sf):
    """The dialects told, with the rows that files of each hold."""
    path = landed_quotes(spark, sf)
    manifest = landing.quote_manifest(spark, path)
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg((F.count("*") - 1).alias("n"))
    return manifest.join(lines, "path").groupBy("separateur", "encodage", "entete", "format").agg(F.sum("n").alias("n"))


def zipped_lines(lines):
    """CSV lines packed into one archive per batch: two members and a file that is no CSV."""
    header = "annee;produit;marche;prix_moyen"

    def pack(batches):
        import io
        import uuid
        import zipfile

        import pyarrow as pa

        for batch in batches:
            body = batch.column(0).to_pylist()
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("a.csv", "\n".join([header, *body[::2]]) + "\n")
                archive.writestr("sub/b.CSV", "\n".join([header.upper(), *body[1::2]]) + "\n")
                archive.writestr("readme.txt", "x")
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4()}.zip"]), pa.array([buffer.getvalue()], pa.binary())], names=["path", "content"])

    return lines.mapInArrow(pack, "path string, content binary")


@query(with_tables("quotes") + " SELECT annee, produit, marche, prix_moyen, count(*) AS n FROM quotes GROUP BY ALL")
def quotes_from_archives(spark, sf):
    quotes = standin(spark, sf, "quotes").select(F.concat_ws(";", "annee", "produit", "marche", _comma("prix_moyen")).alias("line"))
    path = scratch_path(spark, "archives")
    zipped_lines(quotes).write.parquet(path)
    stored = spark.read.parquet(path)
    rows, _ = archives.archive_rows(stored, landing.QUOTE_DIALECT, conform_quotes)
    return rows.groupBy("annee", "produit", "marche", "prix_moyen").agg(F.count("*").alias("n"))


def landed_sales(spark, sf) -> str:
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    path = scratch_path(spark, "sales")
    day = F.date_add(F.lit("2015-01-01").cast("date"), (key % 3000).cast("int"))
    place = (F.lit(42.0) + (key * 6007 + 17) % 9000 / F.lit(1000.0), F.lit(-4.5) + (key * 15485863 + 5) % 12000 / F.lit(1000.0))
    text = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.lpad(((key * 7) % 1000).cast("string"), 3, "0"), F.lit(",5"))
    columns = [day.cast("string").alias("date_mutation"), F.format_number(F.floor(F.col("p_retailprice") * 1000), 0).alias("VALEUR FONCIERE"),
               F.lpad((key % 96).cast("string"), 3, "0").alias("code_dept"), key.cast("string").alias("id_parcel"),
               F.when(key % 9 != 0, key % 7).alias("nombre_pieces"), place[0].alias("lat"), place[1].alias("lon"), text.alias("surface_terrain")]
    part.filter("p_partkey % 2 = 0").select(columns).write.option("header", True).option("sep", ";").csv(f"{path}/a")
    part.filter("p_partkey % 2 = 1").select(columns).write.option("header", True).csv(f"{path}/b")
    return f"{path}/*"


SALES = """WITH part_days AS (SELECT *, DATE '2015-01-01' + CAST(p_partkey % 3000 AS INT) AS d FROM part),
 landed AS (SELECT CAST(year(d) AS INT) AS annee, CAST(quarter(d) AS INT) AS trimestre, CAST(d AS STRING) AS date_mutation, CAST(floor(p_retailprice * 1000) AS DOUBLE) AS valeur_fonciere,
  lpad(CAST(p_partkey % 96 AS STRING), 3, '0') AS code_departement, CAST(p_partkey AS STRING) AS id_parcelle,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 7 AS INT) END AS nombre_pieces_principales,
  42.0 + ((p_partkey * 6007 + 17) % 9000) / 1000.0::DOUBLE AS latitude, -4.5 + ((p_partkey * 15485863 + 5) % 12000) / 1000.0::DOUBLE AS longitude,
  p_size * 1000 + (p_partkey * 7) % 1000 + 0.5::DOUBLE AS surface_terrain FROM part_days)"""
SALE_COLUMNS = ["annee", "trimestre", "date_mutation", "valeur_fonciere", "code_departement", "id_parcelle", "nombre_pieces_principales",
                "latitude", "longitude", "surface_terrain"]


def _read_sales(spark, sf):
    manifest = landing.sale_manifest(spark, landed_sales(spark, sf))
    return fill_sale_period(landing.read_csv_files(spark, manifest, conform_sales)).select(LAND_SALES.fieldNames())


@query(SALES + " SELECT * FROM landed")
def sales_from_csv(spark, sf):
    return _read_sales(spark, sf).select(SALE_COLUMNS)


#: Lines of a landed file, about.
FILE_LINES = 50_000


def _dealt_lines(rows, n: int, name: str, ending: str, line):
    """(name, lines): lines of a year dealt into files of bounded size, however many rows the year has; ``n`` rows in all."""
    files = max(1, -(-n // FILE_LINES))
    number = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    # Partition ids are the high bits, so each partition deals its rows evenly.
    dealt = rows.select("annee", line.alias("line"), number.alias("number"))
    return dealt.groupBy(F.format_string(f"{name}.{ending}", "annee", "number").alias("name")).agg(F.collect_list("line").alias("lines"))


def _landed_files(rows, path, header: str, packed: bool):
    """Real files: one CSV or ZIP per row of ``rows`` (name, lines), with that header and quoted line breaks."""

    def write(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            names, bodies = [], []
            for name, lines in zip(batch.column("name").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                body = "\n".join([header, *lines]).encode()
                if packed:
                    buffer = io.BytesIO()
                    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                        archive.writestr("a.csv", body)
                        archive.writestr("notes.txt", "x")
                    # A text file ends with a line break; what follows an archive is no part of it.
                    body = buffer.getvalue()
                names.append(name)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies, pa.binary())], ["name", "body"])

    files = rows.mapInArrow(write, "name string, body binary").select("name", F.col("body").cast("string").alias("value"))
    # All lines of a file are in one row, so each folder gets one part file; files of a year are written side by side.
    files.write.mode("append").partitionBy("name").option("lineSep", "\n").text(path)
    return files


def _named_files(spark, path: str) -> str:
    """Each folder's one part file, moved to the folder's name: jobs tell years and formats from file names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = f"{path}-named"
    fs.mkdirs(hadoop.Path(out))
    for folder in fs.globStatus(hadoop.Path(path, "name=*")):
        part = fs.globStatus(hadoop.Path(folder.getPath(), "part-*"))[0].getPath()
        fs.rename(part, hadoop.Path(out, folder.getPath().getName().removeprefix("name=")))
    return out


_QUOTE_FILES = with_tables("quotes") + """, named AS (SELECT annee + 10 AS annee, produit, marche, prix_moyen, CASE WHEN marche = 'MARCHE 1' THEN concat(marche, chr(10), 'HALLE "B"') ELSE marche END AS place FROM quotes)"""


@query(_QUOTE_FILES + """ SELECT count(*) AS n_cotations, min(annee) AS premiere_annee, max(annee) AS derniere_annee, count(DISTINCT produit) AS n_produits, count(DISTINCT place) AS n_marches,
  CAST(count(*) FILTER (WHERE contains(place, chr(10))) AS BIGINT) AS n_coupes, 1 AS n_illisibles FROM named""")
def loaded_quotes_job(spark, sf):
    """Files and archives by year with line breaks in cells, beside a broken archive and a foreign format."""
    quotes = standin(spark, sf, "quotes").withColumn("annee", F.col("annee") + 10)
    place = F.when(F.col("marche") == "MARCHE 1", F.concat(F.lit('"'), "marche", F.lit('\nHALLE ""B"""'))).otherwise(F.col("marche"))
    line = F.concat_ws(";", "annee", "produit", place, F.coalesce(F.replace(F.col("prix_moyen").cast("string"), F.lit("."), F.lit(",")), F.lit("")))
    path = scratch_path(spark, "deliveries")
    header = "annee;produit;marche;prix_moyen"
    counts = {r.annee: r["count"] for r in quotes.groupBy("annee").count().collect()}
    for packed, ending in ((False, "csv"), (True, "zip")):
        part = quotes.filter(F.pmod("annee", F.lit(2)) == int(packed))
        n = sum(count for year, count in counts.items() if year is not None and year % 2 == int(packed))
        lines = _dealt_lines(part, n, "rnm_%s_%s", ending, line)
        _landed_files(lines, path, header, packed)
    first = min((year for year in counts if year is not None), default=None)
    for name in (f"rnm_{first}_suite.zip", f"rnm_{first}.xlsx"):
        spark.range(1).select(F.lit("no archive").alias("value")).coalesce(1).write.text(f"{path}/name={name}")
    years = list(counts)
    out, bad = scratch_path(spark, "quotes_table"), scratch_path(spark, "quarantine")
    summary = jobs.load_quotes(spark, _named_files(spark, path), out, years, quarantine=bad)
    stored = spark.read.parquet(out)
    return summary.select("n_cotations", "premiere_annee", "derniere_annee", "n_produits", "n_marches").withColumns({
        "n_coupes": stored.filter(F.col("marche").contains("\n")).agg(F.count("*")).scalar(),
        "n_illisibles": spark.read.parquet(bad).agg(F.count("*").cast("int")).scalar()})


_SALE_YEARS = "WITH s AS (SELECT CAST(2015 + p_partkey % 4 AS INT) AS annee, p_partkey, p_retailprice FROM part)"


@query(_SALE_YEARS + """ SELECT annee, count(*) AS n, CAST(sum(floor(p_retailprice)) AS DOUBLE) AS total FROM s WHERE annee IN (2015, 2016, 2017) GROUP BY annee""")
def loaded_sales_job(spark, sf):
    """Three of four years, each row delivered twice, half of them zipped."""
    key = F.col("p_partkey")
    sales = table(spark, sf, "part").withColumn("annee", (2015 + key % 4).cast("int"))
    line = F.concat_ws(",", F.concat(F.col("annee"), F.lit("-03-01")), F.floor("p_retailprice").cast("string"), F.lit("72"), key.cast("string"),
                       F.concat(F.lit('"x\n'), key, F.lit('"')))
    path = scratch_path(spark, "sale_files")
    for packed, ending in ((False, "csv"), (True, "zip")):
        part = sales.filter(F.col("annee") % 2 == int(packed))
        lines = _dealt_lines(part.unionAll(part), 2 * part.count(), "dvf_%s_T1_%s", ending, line)
        _landed_files(lines, path, "date_mutation,valeur_fonciere,code_departement,id_parcelle,nature_mutation", packed)
    out = scratch_path(spark, "sales_table")
    counts = jobs.load_sales(spark, _named_files(spark, path), out, [2015, 2016, 2017], ["72"])
    totals = spark.read.parquet(out).groupBy("annee").agg(F.sum("valeur_fonciere").alias("total"))
    return counts.join(totals, "annee")


@query(SALES + " SELECT id_parcelle, code_departement FROM landed WHERE CAST(code_departement AS INT) IN (7, 72, 10)")
def sales_of_departments(spark, sf):
    return filters.in_departments(_read_sales(spark, sf), ["07", "072", "10"]).select("id_parcelle", "code_departement")


@query(SALES + f""", kept AS (SELECT DISTINCT * FROM landed WHERE CAST(code_departement AS INT) BETWEEN 1 AND 89 AND latitude BETWEEN {SITE_LAT} - 300 / 111.32::DOUBLE AND {SITE_LAT} + 300 / 111.32::DOUBLE
  AND longitude BETWEEN {SITE_LON} - 300 / (111.32::DOUBLE * cos(radians({SITE_LAT}))) AND {SITE_LON} + 300 / (111.32::DOUBLE * cos(radians({SITE_LAT}))))
  SELECT annee, count(*) AS n FROM kept GROUP BY annee""")
def stored_sales_per_year(spark, sf):
    kept = filters.sales_of(_read_sales(spark, sf), [str(i) for i in range(90)], SITE_LAT, SITE_LON, 300)
    path = scratch_path(spark, "sales_table")
    tables.write_years(jobs.summaries.distinct_rows(kept.unionByName(kept)), path)
    return jobs.summaries.rows_per(spark.read.parquet(path))


@query(QUOTES + """ SELECT min(annee) AS premiere_annee, max(annee) AS derniere_annee, count(*) AS n_cotations, count(DISTINCT produit) AS n_produits,
  count(DISTINCT marche) AS n_marches, 0 AS n_origines FROM landed WHERE stade = 'A'""")
def stored_quotes_job(spark, sf):
    path = scratch_path(spark, "quotes_table")
    tables.write_years(filters.quotes_of(_read_quotes(spark, landed_quotes(spark, sf)).drop("_file", "_name"), None, ["a"]), path)
    return jobs.summaries.quote_summary(spark.read.parquet(path)).withColumn("n_origines", F.col("n_origines").cast("int"))


def _lists_of(spark, lines_path: str, head: str, tail: str) -> str:
    """JSON records, one a line, as files of one list each, of a bounded number of records."""
    lines = spark.read.text(lines_path)
    files = max(1, -(-lines.count() // FILE_LINES))
    dealt = lines.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(files)).alias("number")).agg(
        F.concat(F.lit(head), F.concat_ws(",\n", F.collect_list("value")), F.lit(tail)).alias("value"))
    path = scratch_path(spark, "lists")
    dealt.write.partitionBy("number").text(path)
    return path


def landed_wells(spark, sf) -> str:
    wells = standin(spark, sf, "wells")
    lists = F.when(F.col("nb_mesures_piezo") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("code_bdlisa", F.lit("autre")))
    record = F.struct("code_bss", "code_departement", "nom_departement", F.col("longitude").alias("x"), F.col("latitude").alias("y"),
                      F.when(F.col("nb_mesures_piezo") % 4 == 0, F.lit("n.c.")).otherwise(F.col("nb_mesures_piezo").cast("string")).alias("altitude_station"),
                      "profondeur_investigation", "nb_mesures_piezo", lists.alias("codes_bdlisa"))
    path = scratch_path(spark, "wells")
    wells.select(F.to_json(record).alias("value")).write.text(path)
    return path


WELLS = with_tables("wells") + f""", landed AS (SELECT code_bss, code_departement, nom_departement, longitude, latitude,
  CASE WHEN nb_mesures_piezo % 4 <> 0 THEN CAST(nb_mesures_piezo AS DOUBLE) END AS altitude_station, profondeur_investigation, nb_mesures_piezo,
  CASE WHEN nb_mesures_piezo % 5 <> 0 THEN code_bdlisa END AS code_bdlisa, round({SITE_KM}, 2) AS distance_km FROM wells)"""


@query(WELLS + " SELECT * FROM landed")
def wells_from_json(spark, sf):
    wells = records.read_wells(spark, landed_wells(spark, sf), SITE_LAT, SITE_LON)
    return wells.select("code_bss", "code_departement", "nom_departement", "longitude", "latitude", "altitude_station", "profondeur_investigation",
                        "nb_mesures_piezo", "code_bdlisa", "distance_km")


@query(WELLS + " SELECT * FROM landed")
def wells_from_pages(spark, sf):
    """Pages with the list under "data", between other keys that hold objects and lists."""
    pages = _lists_of(spark, landed_wells(spark, sf), '{"count": 2, "links": [{"data": [{"code_bss": "}"}]}],\n "data" : [', '], "api": {"v": [{}]}}')
    wells = records.read_wells(spark, pages, SITE_LAT, SITE_LON, "data")
    return wells.select("code_bss", "code_departement", "nom_departement", "longitude", "latitude", "altitude_station", "profondeur_investigation",
                        "nb_mesures_piezo", "code_bdlisa", "distance_km")


@query(WELLS + f" SELECT nom_departement, count(*) AS n, round(avg(profondeur_investigation), 1) AS prof_moy_m FROM landed WHERE {SITE_KM} <= 350 GROUP BY 1")
def stored_wells_job(spark, sf):
    return jobs.load_wells(spark, landed_wells(spark, sf), scratch_path(spark, "wells_table"), SITE_LAT, SITE_LON, 350)


def landed_groundwater(spark, sf) -> str:
    g, no = standin(spark, sf, "groundwater"), F.col("mesure")
    day = F.col("date_mesure").cast("string")
    record = F.struct(
        F.coalesce("code_bss", F.lit("")).alias("code_bss"),
        F.when(no % 11 == 0, F.lit("pas-une-date")).when(no % 2 == 0, F.concat(day, F.lit("T00:00:00"))).otherwise(day).alias("date_mesure"),
        F.when(no % 13 == 0, F.lit("n.a.")).otherwise(F.col("profondeur_nappe").cast("string")).alias("profondeur_nappe"),
        F.col("niveau_eau_ngf"), "qualification",
        F.when(no % 3 == 0, F.lit("invalide")).otherwise((no % 4).cast("string")).alias("code_qualification"), F.lit("auto").alias("mode_obtention"))
    path = scratch_path(spark, "groundwater")
    g.select(F.to_json(record).alias("value")).write.text(path)
    return path


GROUNDWATER = with_tables("groundwater", "wells") + """, landed AS (SELECT code_bss, CASE WHEN mesure % 11 <> 0 THEN date_mesure END AS date_mesure,
  CASE WHEN mesure % 13 <> 0 THEN profondeur_nappe END AS profondeur_nappe, niveau_eau_ngf, qualification,
  CASE WHEN mesure % 3 <> 0 THEN mesure % 4 END AS code_qualification FROM groundwater)"""


@query(GROUNDWATER + " SELECT code_bss, date_mesure, profondeur_nappe, niveau_eau_ngf, qualification, code_qualification FROM landed")
def groundwater_from_json(spark, sf):
    return records.read_groundwater(spark, landed_groundwater(spark, sf)).drop("mode_obtention")


@query(GROUNDWATER + " SELECT code_bss, date_mesure, profondeur_nappe, niveau_eau_ngf, qualification, code_qualification FROM landed")
def groundwater_from_lists(spark, sf):
    lists = _lists_of(spark, landed_groundwater(spark, sf), "[", "]")
    return records.read_groundwater(spark, lists, "array").drop("mode_obtention")


@query(GROUNDWATER + f""" SELECT code_bss, count(*) AS n, min(date_mesure) AS debut, max(date_mesure) AS fin, round(avg(profondeur_nappe), 2) AS prof_moy_m FROM landed
  WHERE date_mesure BETWEEN DATE '1997-01-01' AND DATE '2000-06-30'
    AND code_bss IN (SELECT code_bss FROM wells WHERE {SITE_KM} <= 350 ORDER BY round({SITE_KM}, 2), code_bss LIMIT 12) GROUP BY 1""")
def stored_groundwater_job(spark, sf):
    wells = scratch_path(spark, "wells_table")
    jobs.load_wells(spark, landed_wells(spark, sf), wells, SITE_LAT, SITE_LON, 350)
    return jobs.load_groundwater(spark, landed_groundwater(spark, sf), wells, scratch_path(spark, "groundwater_table"), dt.date(2000, 6, 30), 1997, 12)


def landed_features(spark, sf) -> str:
    """Squares of a tenth of a degree; every third one a MultiPolygon, some properties in upper case."""
    crops = standin(spark, sf, "crops")
    x, y, no = F.col("x"), F.col("y"), F.col("id_parcel").cast("bigint")
    ring = F.array(F.array(x, y), F.array(x + 0.5, y), F.array(x + 0.5, y + 0.5), F.array(x, y))
    shape = F.when(no % 3 == 0, F.to_json(F.array(F.array(ring)))).otherwise(F.to_json(F.array(ring)))
    kind = F.when(no % 3 == 0, "MultiPolygon").otherwise("Polygon")
    geometry = F.when(no % 50 == 0, F.lit('{"type":"Point","coordinates":[1.0,2.0]}')).otherwise(
        F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}")))
    lower = F.to_json(F.struct("id_parcel", F.col("code_culture").alias("code_cultu"), F.col("surface_ha").alias("surf_parc")))
    upper = F.to_json(F.struct(F.col("id_parcel").alias("ID_PARCEL"), F.col("code_culture").alias("CODE_CULTU"), F.col("surface_ha").alias("SURF_PARC")))
    line = F.concat(F.lit('{"properties":'), F.when(no % 2 == 0, lower).otherwise(upper), F.lit(',"geometry":'), geometry, F.lit("}"))
    path = scratch_path(spark, "features")
    crops.select(line.alias("value")).write.text(path)
    return path


_CODES = ", ".join(f"('{k}', '{v}')" for k, v in CROP_LABELS.items())
_P = [f"concat(CAST(x + {dx}::DOUBLE AS STRING), ' ', CAST(y + {dy}::DOUBLE AS STRING))" for dx, dy in ((0, 0), (.5, 0), (.5, .5), (0, 0))]
_RING = "concat('((', " + ", ',', ".join(_P) + ", '))')"
CROPS = with_tables("crops") + f""", codes(code, label) AS (VALUES {_CODES}), landed AS (SELECT id_parcel, code_culture, surface_ha, coalesce(label, 'Inconnu') AS libelle_culture, x, y,
  CASE WHEN CAST(id_parcel AS BIGINT) % 50 = 0 THEN '' WHEN CAST(id_parcel AS BIGINT) % 3 = 0 THEN concat('MULTIPOLYGON(', {_RING}, ')') ELSE concat('POLYGON', {_RING}) END AS geometry_wkt
  FROM crops LEFT JOIN codes ON code = code_culture)"""


@query(CROPS + " SELECT id_parcel, code_culture, surface_ha, libelle_culture, geometry_wkt FROM landed")
def crop_parcels_from_geojson(spark, sf):
    return records.crop_parcel_rows(records.read_features(spark, landed_features(spark, sf)))


@query(CROPS + " SELECT id_parcel, code_culture, surface_ha, libelle_culture, geometry_wkt FROM landed")
def crop_parcels_from_collections(spark, sf):
    """FeatureCollections as files have them, the reference system before the features."""
    system = '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": ['
    collections = _lists_of(spark, landed_features(spark, sf), system, "]}")
    return records.crop_parcel_rows(records.read_features(spark, collections, "collection"))


IN_BOX = f"""geometry_wkt <> '' AND x <= {SITE_LON} + 100 / (111.32::DOUBLE * cos(radians({SITE_LAT}))) AND x + 0.5 >= {SITE_LON} - 100 / (111.32::DOUBLE * cos(radians({SITE_LAT})))
  AND y <= {SITE_LAT} + 100 / 111.32::DOUBLE AND y + 0.5 >= {SITE_LAT} - 100 / 111.32::DOUBLE"""


@query(CROPS + f" SELECT id_parcel FROM landed WHERE {IN_BOX}")
def crop_parcels_in_box(spark, sf):
    features = records.read_features(spark, landed_features(spark, sf))
    return records.crop_parcel_rows(records.features_in_box(features, SITE_LAT, SITE_LON, 100)).select("id_parcel")


def landed_lambert93(spark, sf) -> str:
    """Triangles of 250 m in metres of EPSG:2154, all over the country; every third one a MultiPolygon with heights."""
    crops = standin(spark, sf, "crops").withColumn("no", F.col("id_parcel").cast("bigint"))
    x = (F.lit(150000) + F.col("no") * 7919 % 1000000).cast("double")
    y = (F.lit(6080000) + F.col("no") * 104729 % 1000000).cast("double")
    corners = ((x, y), (x + 250, y), (x, y + 250), (x, y))
    flat = F.to_json(F.array(F.array(*(F.array(a, b) for a, b in corners))))
    high = F.to_json(F.array(F.array(F.array(*(F.array(a, b, F.lit(80.5)) for a, b in corners)))))
    several = F.col("no") % 3 == 0
    geometry = F.concat(F.lit('{"type":"'), F.when(several, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'),
                        F.when(several, high).otherwise(flat), F.lit("}"))
    properties = F.to_json(F.struct(F.col("id_parcel").alias("ID_PARCEL"), F.col("code_culture").alias("CODE_CULTU")))
    path = scratch_path(spark, "lambert93")
    crops.select(F.concat(F.lit('{"properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value")).write.text(path)
    return path


# The SQL finds the cone and, by repeated substitution, the latitude on its own; shapes have nine decimals.
_ISOMETRIC = "ln(tan(pi() / 4 + {0} / 2) * pow((1 - e * sin({0})) / (1 + e * sin({0})), e / 2))"
_NEXT = "2 * atan(exp(iso) * pow((1 + e * sin({0})) / (1 - e * sin({0})), e / 2)) - pi() / 2"
_TURNS = "".join(f", s{i + 1} AS (SELECT *, {_NEXT.format(f'phi{i}')} AS phi{i + 1} FROM s{i})" for i in range(8))
LAMBERT93 = with_tables("crops") + f""", ell AS (SELECT sqrt(2 / 298.257222101::DOUBLE - 1 / pow(298.257222101::DOUBLE, 2)) AS e, radians(44) AS p1, radians(49) AS p2, radians(46.5) AS p0),
  cone AS (SELECT *, (ln(cos(p1) / sqrt(1 - pow(e * sin(p1), 2))) - ln(cos(p2) / sqrt(1 - pow(e * sin(p2), 2)))) / ({_ISOMETRIC.format('p2')} - {_ISOMETRIC.format('p1')}) AS n FROM ell),
  scaled AS (SELECT *, 6378137 * cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) * exp(n * {_ISOMETRIC.format('p1')}) / n AS c FROM cone),
  corners AS (SELECT id_parcel, 150000 + CAST(id_parcel AS BIGINT) * 7919 % 1000000 + dx - 700000 AS x,
    c * exp(-n * {_ISOMETRIC.format('p0')}) - (6080000 + CAST(id_parcel AS BIGINT) * 104729 % 1000000 + dy - 6600000) AS y, e, n, c
    FROM crops, scaled, (VALUES (0, 0), (250, 0), (0, 250)) AS d(dx, dy)),
  turned AS (SELECT *, ln(c / sqrt(x * x + y * y)) / n AS iso, 3 + degrees(atan2(x, y)) / n AS lon FROM corners),
  s0 AS (SELECT *, 2 * atan(exp(iso)) - pi() / 2 AS phi0 FROM turned){_TURNS},
  nine AS (SELECT id_parcel, round(lon, 9) AS lon, round(degrees(phi8), 9) AS lat FROM s8),
  placed AS (SELECT id_parcel, min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max FROM nine GROUP BY 1)"""


@query(LAMBERT93 + """ SELECT id_parcel, round(lon_min, 5) AS lon_min, round(lat_min, 5) AS lat_min, round(lon_max, 5) AS lon_max, round(lat_max, 5) AS lat_max
  FROM placed""")
def crop_parcels_from_lambert93(spark, sf):
    features = records.features_from_lambert93(records.read_features(spark, landed_lambert93(spark, sf)))
    box = geo.envelope(geo.polygons(F.col("geometry.type"), F.col("geometry.coordinates")))
    return features.select(F.col("properties")["ID_PARCEL"].alias("id_parcel"), *(rounded(c, 5).alias(n) for n, c in box.items()))


@query(CROPS + f" SELECT libelle_culture, count(*) AS n, round(sum(surface_ha), 1) AS ha FROM landed WHERE {IN_BOX} GROUP BY 1 ORDER BY ha DESC, libelle_culture LIMIT 10")
def stored_crop_parcels_job(spark, sf):
    return jobs.load_crop_parcels(spark, landed_features(spark, sf), scratch_path(spark, "crops_table"), 2023, SITE_LAT, SITE_LON, 100)


@query(CROPS + f""" SELECT annee, libelle_culture, count(*) AS n, round(sum(surface_ha), 1) AS ha FROM landed, (VALUES (2022), (2023)) AS y(annee)
  WHERE {IN_BOX} AND (annee = 2023 OR CAST(id_parcel AS BIGINT) % 2 = 0) GROUP BY ALL""")
def stored_crop_years_job(spark, sf):
    """Two yearly loads, and one that finds nothing: every year stays."""
    path = scratch_path(spark, "crop_years")
    everything = landed_features(spark, sf)
    even = scratch_path(spark, "features")
    spark.read.text(everything).filter(F.regexp_extract(F.lower("value"), '"id_parcel":"([0-9]+)"', 1).cast("bigint") % 2 == 0).write.text(even)
    jobs.load_crop_parcels(spark, even, path, 2022, SITE_LAT, SITE_LON, 100)
    jobs.load_crop_parcels(spark, everything, path, 2023, SITE_LAT, SITE_LON, 100)
    jobs.load_crop_parcels(spark, everything, path, 2023, -SITE_LAT, SITE_LON, 100)
    return spark.read.parquet(path).groupBy("annee", "libelle_culture").agg(F.count("*").alias("n"), rounded(F.sum("surface_ha"), 1).alias("ha"))


def landed_log(spark, sf) -> str:
    h, no = standin(spark, sf, "hours"), F.col("id").cast("bigint")
    path = scratch_path(spark, "log")
    h.select("id", F.when(no % 17 == 0, F.lit("?")).otherwise(F.col("date").cast("string")).alias("date"), F.lit("").alias("debut"), F.lit("").alias("fin"),
             F.when(no % 19 == 0, F.lit("x")).otherwise(F.col("duree_h").cast("string")).alias("duree_h"), "poste", F.lit("a,b").alias("notes"),
             F.lit("manuel").alias("source")).write.option("header", True).csv(path)
    return path


LOG = with_tables("hours") + """, landed AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 17 <> 0 THEN date END AS date,
  CASE WHEN CAST(id AS BIGINT) % 19 <> 0 THEN duree_h END AS duree_h, poste, 'a,b' AS notes FROM hours)"""


@query(LOG + """ SELECT id, date, duree_h, poste, notes, CAST(year(date) AS INT) AS annee, CAST(month(date) AS INT) AS mois, CAST(week(date) AS INT) AS semaine,
  CAST(isodow(date) AS INT) AS jour_semaine FROM landed""")
def hours_from_csv(spark, sf):
    log = landing.read_work_log(spark, landed_log(spark, sf))
    return hours.typed_hours(log).select("id", "date", "duree_h", "poste", "notes", "annee", "mois", "semaine", "jour_semaine")


@query(LOG + " SELECT poste, count(*) AS n, round(sum(duree_h), 1) AS heures FROM landed GROUP BY poste")
def stored_hours_job(spark, sf):
    return jobs.load_hours(spark, landed_log(spark, sf), scratch_path(spark, "hours_table"))[1]


@query(with_tables("parcels") + " SELECT id, nom, surface_ha, lat, lon, prix_achat, pente_pct, risque_gel_tardif, meteo_jours_gel FROM parcels WHERE coalesce(prix_achat, 0) >= 0")
def parcels_from_documents(spark, sf):
    path = scratch_path(spark, "parcels")
    records.write_parcels(standin(spark, sf, "parcels"), path)
    valid = records.valid_parcels(records.read_parcels(spark, path, "lines"))
    return valid.select("id", "nom", "surface_ha", "lat", "lon", "prix_achat", "pente_pct", "risque_gel_tardif", "meteo_jours_gel")


@query(LOG + " SELECT poste, 2 * count(*) AS n, CAST(NULL AS STRING) AS fin FROM landed GROUP BY poste")
def appended_log(spark, sf):
    path = scratch_path(spark, "appended")
    rows = hours.typed_hours(landing.read_work_log(spark, landed_log(spark, sf)))
    tables.append_rows(rows, path)
    tables.append_rows(rows, path)
    stored, _ = tables.with_missing_columns(spark.read.parquet(path).drop("fin"), struct(("fin", STRING)))
    return stored.groupBy("poste").agg(F.count("*").alias("n"), F.max("fin").alias("fin"))


@query("""SELECT CAST(2000 + o_orderkey % 12 AS INT) AS annee, CAST(1 + o_orderkey % 4 AS INT) AS trimestre, count(*) AS n FROM orders WHERE o_orderkey % 12 IN (3, 5) AND o_orderkey % 3 <> 2 GROUP BY ALL""")
def files_of_wanted_years(spark, sf):
    """A manifest with one file per order."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("DVF "), (2000 + key % 12).cast("string"), F.lit(" T"), (1 + key % 4).cast("string"), F.lit(" "))
    manifest = table(spark, sf, "orders").select(
        name.alias("path"), landing.text.year_in_text(name).alias("annee"), landing.text.quarter_in_text(name).alias("trimestre"),
        F.when(key % 3 == 0, "CSV").when(key % 3 == 1, "ZIP").otherwise("XLS").alias("format"))
    return filters.files_of_years(manifest, [2003, 2005]).groupBy("annee", "trimestre").agg(F.count("*").alias("n"))
