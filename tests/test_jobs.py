import datetime as dt
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from glebe.operators import latest, summaries
from glebe.plans import jobs
from glebe.schemas import WEATHER_DAILY
from glebe.session import drop_scratch, scratch_path, work_dir
from glebe.sources import tables
from glebe.streaming.weather import merge_batch, stream_weather
from helpers import rows
from test_scoring import PARCEL_ROWS
from test_sources import DATED, NEW, NO_YEAR, OLD, PAYLOAD, WELL_RECORDS, damaged_zip

D = dt.date


def payload(days, lat=46.0, lon=2.0):
    return json.dumps({"latitude": lat, "longitude": lon, "daily": {"time": [d.isoformat() for d in days], "temperature_2m_max": list(days.values())}})


def test_quotes_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rnm_2023.csv").write_text(NEW)
    (tmp_path / "in" / "rnm_2022.csv").write_text(OLD)
    (tmp_path / "in" / "rnm_2019.csv").write_text(NO_YEAR)
    (tmp_path / "in" / "rnm_2023.xlsx").write_text("x")
    with zipfile.ZipFile(tmp_path / "in" / "COT-A22.zip", "w") as z:
        z.writestr("a.csv", NO_YEAR)
        z.writestr("b.csv", DATED.encode("latin-1"))
    out = str(tmp_path / "table")
    summary = jobs.load_quotes(spark, str(tmp_path / "in"), out, [2022, 2023]).first()
    assert (summary.premiere_annee, summary.derniere_annee, summary.n_cotations, summary.n_produits) == (2022, 2026, 9, 8)
    years = {r.annee: r.n for r in summaries.rows_per(spark.read.parquet(out)).collect()}
    assert years == {2022: 4, 2023: 3, 2026: 1, None: 1}
    filtered = jobs.load_quotes(spark, str(tmp_path / "in"), str(tmp_path / "t2"), [2022, 2023], ["LYON"], ["gros"]).first()
    assert filtered.n_cotations == 5
    with pytest.raises(ValueError):
        jobs.load_quotes(spark, str(tmp_path / "in"), out, [1999])


def test_bad_files_do_not_stop_a_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rnm_2023.csv").write_text(NEW)
    (tmp_path / "in" / "rnm_2022.csv").write_text("")
    (tmp_path / "in" / "COT-A22.zip").write_bytes(b"no archive")
    damaged_zip(tmp_path / "in" / "COT-A23.zip")
    out, bad = str(tmp_path / "table"), str(tmp_path / "bad")
    assert jobs.load_quotes(spark, str(tmp_path / "in"), out, [2022, 2023], quarantine=bad).first().n_cotations == 603
    assert sorted((r.path[-11:], r.member) for r in spark.read.parquet(bad).collect()) == [("COT-A22.zip", None), ("COT-A23.zip", "b.csv")]
    # Only unreadable or unsupported files: nothing is fetched, and the table stays.
    (tmp_path / "in" / "rnm_2021.xlsx").write_text("x")
    for year in (2021, 2022):
        assert jobs.load_quotes(spark, str(tmp_path / "in"), out, [year]).first().n_cotations == 603
    assert jobs.load_sales(spark, str(tmp_path / "in"), str(tmp_path / "sales"), [2021]).count() == 0


def test_crop_years(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]

    def land(name, ids):
        lines = [{"properties": {"id_parcel": i, "code_cultu": "15", "surf_parc": 2.0}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for i in ids]
        (tmp_path / name).write_text("\n".join(map(json.dumps, lines)))
        return str(tmp_path / name)

    table = str(tmp_path / "t")
    assert jobs.load_crop_parcels(spark, land("a.json", ["1", "2"]), table, 2022, 0.5, 0.5, 50).first().n == 2
    assert jobs.load_crop_parcels(spark, land("b.json", ["3"]), table, 2023, 0.5, 0.5, 50).first().n == 1
    assert jobs.load_crop_parcels(spark, land("c.json", ["3"]), table, 2023, 40.0, 0.5, 50).first().n == 1
    assert {(r.id_parcel, r.annee) for r in spark.read.parquet(table).collect()} == {("1", 2022), ("2", 2022), ("3", 2023)}
    assert jobs.load_crop_parcels(spark, land("d.json", []), str(tmp_path / "none"), 2023, 0.5, 0.5, 50).count() == 0


def test_sales_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "2024-03-01;125000;72;47.8;-0.9\n"
    (tmp_path / "in" / "dvf_2024_T1.csv").write_text("date_mutation;valeur_fonciere;code_departement;latitude;longitude\n" + line + line + "2024-03-02;5;53;48.9;3\n")
    with zipfile.ZipFile(tmp_path / "in" / "dvf_2024_T2.zip", "w") as z:
        z.writestr("a.csv", "date_mutation,valeur_fonciere,code_departement,latitude,longitude\n2024-05-01,1,072,47.8,-0.9\n")
    out = str(tmp_path / "t")
    assert rows(jobs.load_sales(spark, str(tmp_path / "in"), out, [2024], ["72"], 47.85, -0.94, 10)) == [(2024, 2)]
    assert rows(spark.read.parquet(out).select("trimestre", "valeur_fonciere"), "trimestre") == [(1, 125000.0), (2, 1.0)]
    assert rows(jobs.load_sales(spark, str(tmp_path / "in"), out, [2024], dedupe=False)) == [(2024, 4)]


def test_water_jobs(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"data": WELL_RECORDS}))
    wells = str(tmp_path / "wells")
    with pytest.raises(FileNotFoundError):
        jobs.load_groundwater(spark, str(tmp_path), wells, str(tmp_path / "g"), D(2024, 6, 1))
    assert jobs.load_wells(spark, str(tmp_path / "w.json"), wells, 45.2, 3.1, 10, "data").first().n == 3
    measures = [{"code_bss": "W-12/B", "date_mesure": d, "profondeur_nappe": 5.0} for d in ("2024-03-15", "2010-01-01", "2023-01-01")]
    measures += [{"code_bss": "W-31/A", "date_mesure": "2024-01-01"}]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, measures)))
    got = jobs.load_groundwater(spark, str(tmp_path / "g.json"), wells, str(tmp_path / "g"), D(2024, 6, 1), n_stations=1)
    assert rows(got) == [("W-12/B", 2, D(2023, 1, 1), D(2024, 3, 15), 5.0)]


def test_weather_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(PAYLOAD))
    table, points = str(tmp_path / "t"), spark.createDataFrame([(46.0, 2.0)], "latitude double, longitude double")
    assert jobs.refresh_weather(spark, str(tmp_path / "in"), table, points, D(2024, 4, 4)).first().n_jours == 3
    (tmp_path / "in" / "a.json").write_text(payload({D(2024, 1, 3): 9.0, D(2024, 1, 4): 1.0, D(2020, 1, 1): 1.0}))
    assert jobs.refresh_weather(spark, str(tmp_path / "in"), table, points, D(2024, 4, 4)).first().n_jours == 4
    shown = jobs.weather_series(spark.read.parquet(table), start=D(2024, 1, 3))
    assert rows(shown.select("date", "t_max")) == [(D(2024, 1, 3), 9.0), (D(2024, 1, 4), 1.0)]


def test_stream(spark, tmp_path):
    landing, table, marks = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "marks")
    landing.mkdir()

    def land(name, body):
        (landing / name).write_text(body)
        stream_weather(spark, str(landing), table, marks, lookback_days=30).awaitTermination()
        return rows(spark.read.parquet(table).select("latitude", "date", "temperature_2m_max"), "latitude", "date")

    first = [(46.0, D(2023, 12, 31), 1.0), (46.0, D(2024, 3, 1), 2.0), (46.0, D(2024, 3, 20), 3.0)]
    assert land("a.json", payload({D(2023, 12, 31): 1.0, D(2024, 3, 1): 2.0, D(2024, 3, 20): 3.0})) == first
    # A correction inside the lookback wins, one before it is dropped, a new point keeps its history.
    got = land("b.json", payload({D(2023, 12, 31): 9.0, D(2024, 3, 1): 8.0, D(2024, 3, 21): 4.0}) + "\n" + payload({D(2020, 1, 1): 5.0, D(2024, 1, 1): 6.0}, lat=47.0))
    assert got == [(46.0, D(2023, 12, 31), 1.0), (46.0, D(2024, 3, 1), 8.0), (46.0, D(2024, 3, 20), 3.0), (46.0, D(2024, 3, 21), 4.0),
                   (47.0, D(2020, 1, 1), 5.0), (47.0, D(2024, 1, 1), 6.0)]


def test_replayed_batch_leaves_the_table(spark, tmp_path):
    from glebe.streaming.weather import merge_batch

    table = str(tmp_path / "t")
    batch = spark.createDataFrame([(D(2024, 3, 1), 1.0, 1.0), (D(2019, 3, 1), 1.0, 1.0)], "date date, latitude double, longitude double")
    merge_batch(spark, batch, table)
    before = rows(spark.read.parquet(table), "date")
    merge_batch(spark, batch, table)
    assert rows(spark.read.parquet(table), "date") == before and len(before) == 2


def test_evaluation(spark):
    from glebe.schemas import PARCELS

    parcels = spark.createDataFrame(PARCEL_ROWS, PARCELS)
    bad = parcels.limit(1).withColumns({"id": F.lit("bad"), "pente_pct": F.lit(150.0)})
    ranked, quarantine = jobs.evaluate_parcels(parcels.unionByName(bad), None, None, None)
    assert [r.id for r in quarantine.collect()] == ["bad"]
    assert {r.id: (r.score_global, r.rang) for r in ranked.collect()} == {
        "best_1": (92, 1), "north_7": (82, 2), "plain_2": (72, 3), "dry_5": (61, 4), "hill_3": (48, 5)}


def test_dashboard_and_status(spark, tmp_path):
    quotes = spark.createDataFrame([(2024, f"{d:02d}/01/2024", "TOMATE", "RUNGIS", "GROS", "KG", 1.0, float(d), 2.0) for d in range(1, 21)],
                                   "annee int, date string, produit string, marche string, stade string, unite string, prix_min double, prix_moyen double, prix_max double")
    got = jobs.price_dashboard(quotes, ["TOMATE"])
    assert tuple(got["trend"].first()) == (1.5, 19.5, 1200.0)
    assert got["series"].count() == 3 and got["distribution"].first().mediane == 10.5 and got["latest"].first()["Date"] == D(2024, 1, 20)
    path = str(tmp_path / "prix")
    tables.write_all(quotes, path)
    status = jobs.lake_status(spark, {"prix": (path, summaries.quote_last_date()), "rpg": (path, summaries.file_date()), "meteo": (str(tmp_path / "none"), F.col("date"))}, dt.date.today())
    by = {r.source: r for r in status.collect()}
    # A missing column, a damaged file, and a good source.
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    (damaged / "part-0.parquet").write_bytes(b"PAR1 is not enough PAR1")
    report = jobs.lake_status(spark, {"a": (path, F.col("no_such_date")), "b": (str(damaged), F.col("date")), "prix": (path, summaries.quote_last_date())},
                              dt.date(2024, 1, 25))
    assert [(r.source, r.status) for r in report.collect()] == [("a", summaries.FAILED), ("b", summaries.FAILED), ("prix", summaries.FRESH)]
    assert by["prix"].last_update == D(2024, 1, 20) and by["prix"].status == summaries.OLD
    assert by["rpg"].status == summaries.FRESH and by["meteo"].status == summaries.FAILED


def test_work_dir(spark):
    assert work_dir(spark) == work_dir(spark) and scratch_path(spark, "a") != scratch_path(spark, "a")


def test_scratch_is_dropped_in_the_work_folder_only(spark, tmp_path):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    drop_scratch(spark, path)
    drop_scratch(spark, path)
    assert tables.read_table(spark, path) is None
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        drop_scratch(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_a_table_with_repeated_keys_is_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1., 1., D(2024, 3, 1), 5., 2024)] * 2, "latitude double, longitude double, date date, rain double, annee int")
    tables.write_years(old, path)
    new = spark.createDataFrame([(1., 1., D(2024, 3, 2), 6.)], "latitude double, longitude double, date date, rain double")
    tables.upsert_table(spark, path, new, latest.WEATHER_KEYS)
    assert spark.read.parquet(path).count() == 2
    assert rows(tables.last_days(spark, path, ["latitude", "longitude"])) == [(1., 1., D(2024, 3, 2))]
    before = rows(spark.read.parquet(path), "date")
    tables.upsert_table(spark, path, new.limit(0), latest.WEATHER_KEYS)
    assert rows(spark.read.parquet(path), "date") == before


def test_empty_merge(spark):
    empty = spark.createDataFrame([], WEATHER_DAILY)
    assert latest.upsert(empty, empty).count() == 0


def test_a_removed_table_is_filled_again(spark, tmp_path):
    """Nothing beside the table remembers days that the table no longer has."""
    path = str(tmp_path / "t")
    days = spark.range(200).select(F.lit(46.0).alias("latitude"), F.lit(2.0).alias("longitude"),
                                   F.expr("date_add(DATE'2024-01-01', cast(id AS int))").alias("date"), F.col("id").cast("double").alias("rain"))
    for _ in range(2):
        merge_batch(spark, days, path)
        assert spark.read.parquet(path).count() == 200
        shutil.rmtree(path)
    assert tables.last_days(spark, path, ["latitude", "longitude"]) is None
    merge_batch(spark, days.limit(50), path)
    end = tables.last_days(spark, path, ["latitude", "longitude"])
    assert rows(end) == [(46.0, 2.0, D(2024, 2, 19))]
    tables.write_all(days.limit(2).withColumn("annee", F.year("date")), path)
    assert rows(tables.last_days(spark, path, ["latitude", "longitude"])) == [(46.0, 2.0, D(2024, 1, 2))]


def test_rejected_records_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([payload({D(2024, 4, 1): 1.0}), '{"latitude": 47.5, "error": true}', "{not json"]))
    points, kept = spark.createDataFrame([(46.0, 2.0)], "latitude double, longitude double"), str(tmp_path / "rejects")
    assert jobs.refresh_weather(spark, str(tmp_path / "in"), str(tmp_path / "t"), points, D(2024, 4, 4), rejects=kept).first().n_jours == 1
    got = spark.read.parquet(kept).collect()
    assert {(r.jour, r.raison) for r in got} == {(D(2024, 4, 4), "no daily.time")} and len(got) == 2
    assert "{not json" in {r.contenu for r in got} and any(json.loads(r.contenu)["latitude"] == 47.5 for r in got if r.contenu[1] == '"')

    (tmp_path / "stations").mkdir()
    (tmp_path / "observed").mkdir()
    (tmp_path / "stations" / "s.json").write_text(json.dumps([{"id": "s1", "nom": "S", "lat": 46.1, "lon": 2.1}]))
    (tmp_path / "observed" / "o.json").write_text("\n".join(json.dumps(r) for r in [
        {"station": "s1", "reference_time": "2024-04-01", "TX": 12.0}, {"station": "s1", "DATE": "soon"}, {"station": "s1"}]))
    sites = spark.createDataFrame([("p", 46.0, 2.0)], "id string, lat double, lon double")
    done = jobs.refresh_station_weather(spark, str(tmp_path / "stations"), str(tmp_path / "observed"), str(tmp_path / "st"), sites,
                                        D(2024, 4, 4), rejects=kept)
    assert done.first().n_jours == 1
    again = spark.read.parquet(kept).filter("raison = 'no date'").collect()
    assert sorted(json.loads(r.contenu).get("DATE", "") for r in again) == ["", "soon"]
