import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glebe.operators import conform, filters
from glebe.operators.spatial import by_distance
from glebe.schemas import LAND_SALES, PRICE_QUOTES, WEATHER_DAILY, WELLS
from glebe.sources import archives, landing, records, tables
from helpers import rows

D = dt.date
NEW = """annee;semaine;produit_libelle;marche_libelle;stade_libelle;categorie;calibre;variete;origine;unite;prix_min;prix_max;prix_moyen
2023;14;RADIS BOTTE;LYON;GROS;II;10/12;;BELGIQUE;BOTTE;1.10;1.50;1.25
2023;15;FENOUIL;LILLE;GROS;I;;;ITALIE;KG;1.35;1.95;1.70
2023;15;PANAIS;LYON;GROS;I;;BLANC;FRANCE;KG;0.95;1.45;1.15
"""
OLD = """Annee,Semaine,Produit,Marche,Stade,Categorie,Calibre,Variete,Origine,Unite,Prix Min,Prix Max,Prix Moyen
2022,41,MACHE,LYON,GROS,I,,,FRANCE,BARQUETTE,0.75,1.05,0.90
"""
NO_YEAR = """produit_libelle;marche_libelle;stade_libelle;unite;prix_min;prix_max;prix_moyen
POIREAU;LYON;GROS;KG;0,80;1,20;1,00
AIL;LYON;GROS;KG;nd;-;NA
OIGNON;LYON
"""
DATED = """date_cotation;produit;marche;stade;unite;valeur en euro(s)
08/01/2026;KIWI;Bassin;Expédition;KG;2,5
inconnue;KIWI;Bassin;Expédition;KG;2,6
"""


@pytest.fixture
def quotes_dir(tmp_path):
    (tmp_path / "rnm_2023.csv").write_text(NEW)
    (tmp_path / "rnm_2022.csv").write_text(OLD)
    (tmp_path / "COT-A21.csv").write_text(NO_YEAR)
    (tmp_path / "COT-A25.csv").write_bytes(DATED.encode("latin-1"))
    return tmp_path


def test_quote_manifest_and_files(spark, quotes_dir):
    manifest = landing.quote_manifest(spark, str(quotes_dir / "*.csv"))
    got = {r.name: (r.annee, r.separateur, r.encodage) for r in manifest.collect()}
    assert got == {"rnm_2023.csv": (2023, ";", "UTF-8"), "rnm_2022.csv": (2022, ",", "UTF-8"),
                   "COT-A21.csv": (2021, ";", "UTF-8"), "COT-A25.csv": (2025, ";", "ISO-8859-1")}
    quotes = landing.read_quotes(spark, manifest)
    assert quotes.columns == PRICE_QUOTES.fieldNames()
    by = {(r.produit, r.date): r for r in quotes.collect()}
    assert len(by) == 9
    assert (by["RADIS BOTTE", None].annee, by["RADIS BOTTE", None].semaine, by["RADIS BOTTE", None].prix_moyen) == (2023, 14, 1.25)
    assert (by["MACHE", None].annee, by["MACHE", None].calibre) == (2022, None)
    assert (by["POIREAU", None].annee, by["POIREAU", None].prix_moyen, by["POIREAU", None].prix_min) == (2021, 1.0, 0.8)
    assert (by["AIL", None].prix_min, by["AIL", None].prix_max, by["AIL", None].prix_moyen) == (None, None, None)
    assert (by["OIGNON", None].marche, by["OIGNON", None].prix_min) == ("LYON", None)
    kiwi = by["KIWI", "08/01/2026"]
    assert (kiwi.annee, kiwi.stade, kiwi.prix_min, kiwi.prix_moyen) == (2026, "Expédition", None, 2.5)
    assert by["KIWI", "inconnue"].annee is None
    assert filters.quotes_of(quotes, ["lyon "], ["gros"]).count() == 5
    assert filters.quotes_of(quotes, [], None).count() == 9 and filters.quotes_of(quotes, ["?"]).count() == 0
    listed = spark.createDataFrame([("Lyon",)], "m string")
    assert filters.quotes_of(quotes, listed).count() == 6


@pytest.mark.parametrize("text, dialect, expected", [
    ("a;b;c", "quote", ";"), ("a,b,c", "quote", ","), ("a;b,c", "quote", ";"), ("abc", "quote", ";"),
    ("abc", "sale", ","), ("a;b,c", "sale", ";"), ("a;b\n" + "x" * 2050 + "\n" + ",," * 9, "quote", ";"),
    ("a;b\n" + "x" * 2050 + "\n" + ",," * 9, "sale", ",")])
def test_separator(spark, tmp_path, text, dialect, expected):
    (tmp_path / "f.csv").write_text(text)
    manifest = landing.quote_manifest if dialect == "quote" else landing.sale_manifest
    assert manifest(spark, str(tmp_path)).first().separateur == expected


def test_files_of_years(spark, quotes_dir):
    (quotes_dir / "rnm_2023.xlsx").write_text("x")
    manifest = landing.file_manifest(spark, str(quotes_dir), landing.text.quote_file_year)
    assert [r.name for r in filters.files_of_years(manifest, [2022, 2023]).collect()] == ["rnm_2022.csv", "rnm_2023.csv"]
    with pytest.raises(ValueError, match="2021, 2022, 2023, 2025"):
        filters.files_of_years(manifest, [1999])


def test_names():
    resolve = conform.resolve_names
    aliases = conform.PRICE_QUOTE_ALIASES
    targets = PRICE_QUOTES.fieldNames()
    assert resolve(["semaine"], targets, aliases) == {"semaine": "semaine"}
    assert resolve([" PRIX MOYEN "], targets, aliases) == {"prix_moyen": " PRIX MOYEN "}
    assert resolve(["valeur en euro(s)"], targets, aliases) == {"prix_moyen": "valeur en euro(s)"}
    assert len(resolve(["valeur en euro(s)"], targets, aliases, fan_out=True)) == 3
    both = ["libelle_produit", "produit_libelle"]
    assert resolve(both, targets, aliases, "input")["produit"] == "libelle_produit"
    assert resolve(both, targets, aliases, "alias")["produit"] == "produit_libelle"


def test_sales(spark, tmp_path):
    (tmp_path / "dvf_2024_T1.csv").write_text(
        "date_mutation;valeur_fonciere;code_departement;latitude;longitude\n2024-03-01;125000;72;47.8;-0.9\n")
    (tmp_path / "dvf_autre.csv").write_text(
        'date_mutation,valeur_fonciere,code_departement,lat,lon,surface_terrain\n2023-11-05,"125,000",072,47.85,-0.94,"1 250,5"\n2023-01-05,1,10,48.1,0.1,5\n')
    sales = landing.read_sales(spark, landing.sale_manifest(spark, str(tmp_path)))
    assert sales.columns == LAND_SALES.fieldNames()
    got = rows(sales.select("annee", "trimestre", "valeur_fonciere", "code_departement", "surface_terrain"), "annee", "trimestre")
    assert got == [(2023, 1, 1.0, "10", 5.0), (2023, 4, 125000.0, "072", 1250.5), (2024, 1, 125000.0, "72", None)]
    assert filters.sales_of(sales, ["72"]).count() == 2 and filters.sales_of(sales, ["010"]).count() == 1
    assert filters.sales_of(sales, None, 47.85, -0.94, 10).count() == 2
    assert filters.sales_of(sales).count() == 3


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "COT-A24.zip", "w") as z:
        z.writestr("a.csv", NEW)
        z.writestr("sub/b.CSV", DATED.encode("latin-1"))
        z.writestr("c.csv", NO_YEAR)
        z.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "COT-A20.zip", "w") as z:
        z.writestr("readme.txt", "x")
    (tmp_path / "COT-A19.zip").write_bytes(b"no zip")
    quotes, errors = archives.read_quote_archives(spark, str(tmp_path / "*.zip"))
    assert sorted((r.path[-11:], r.error) for r in errors.collect()) == [("COT-A19.zip", "not a ZIP archive"), ("COT-A20.zip", "no CSV member")]
    got = [(r.produit, r.annee, r.stade) for r in quotes.collect()]
    assert len(got) == 8 and ("KIWI", 2026, "Expédition") in got
    assert ("POIREAU", 2024, "GROS") in got and ("RADIS BOTTE", 2023, "GROS") in got


BROKEN_LINES = 'annee;produit;marche;prix_moyen\n2024;"TO\nMATE; ""X""";LYON;1,5\n2024;"a ""b""";"LILLE\r\nEST";2,5\n2024;plain;LYON;3\n'


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "rnm_2024.csv").write_bytes(BROKEN_LINES.encode())
    (tmp_path / "rnm_2025.csv").write_text(NEW)
    with zipfile.ZipFile(tmp_path / "COT-A24.zip", "w") as z:
        z.writestr("a.csv", BROKEN_LINES)
    manifest = landing.quote_manifest(spark, str(tmp_path / "*.csv"))
    assert {r.name: r.coupe for r in manifest.collect()} == {"rnm_2024.csv": True, "rnm_2025.csv": False}
    expected = {('TO\nMATE; "X"', "LYON", 1.5), ('a "b"', "LILLE\r\nEST", 2.5), ("plain", "LYON", 3.0)}
    plain = landing.read_quotes(spark, manifest).filter("annee = 2024")
    assert {(r.produit, r.marche.replace("\r\n", "\n"), r.prix_moyen) for r in plain.collect()} == {(a, b.replace("\r\n", "\n"), c) for a, b, c in expected}
    zipped, errors = archives.read_quote_archives(spark, str(tmp_path / "*.zip"))
    assert {(r.produit, r.marche, r.prix_moyen) for r in zipped.collect()} == expected and errors.count() == 0


def damaged_zip(path):
    """Three members, the second of them damaged."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.csv", "b.csv", "c.csv"):
            z.writestr(name, "annee;produit\n" + "".join(f"2024;{name} {i * 7919 % 1000}\n" for i in range(300)))
        start = z.getinfo("b.csv").header_offset
    data = bytearray(path.read_bytes())
    for i in range(start + 200, start + 230):
        data[i] ^= 0x5A
    path.write_bytes(bytes(data))


def test_a_damaged_member_leaves_the_others(spark, tmp_path):
    damaged_zip(tmp_path / "COT-A24.zip")
    (tmp_path / "COT-A23.zip").write_bytes(b"PK not really")
    quotes, errors = archives.read_quote_archives(spark, str(tmp_path / "*.zip"))
    assert quotes.count() == 600 and {r.produit[:5] for r in quotes.collect()} == {"a.csv", "c.csv"}
    assert sorted((r.path[-11:], r.member) for r in errors.collect()) == [("COT-A23.zip", None), ("COT-A24.zip", "b.csv")]
    rows_, errors = archives.read_quote_archives(spark, str(tmp_path / "COT-A23.zip"))
    assert rows_.count() == 0 and rows_.columns == PRICE_QUOTES.fieldNames() and errors.count() == 1


PAYLOAD = {"latitude": 46.0, "longitude": 2.0, "daily": {
    "time": ["2024-01-01", "2024-01-02", "2024-01-03"], "temperature_2m_max": [10.0, 12.0, 8.5],
    "temperature_2m_min": [4.0, None, 2.0], "precipitation_sum": [0.0, 2.5, 0.0]}}


def test_weather_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in (PAYLOAD, {"latitude": 1.0, "daily": {}}, {"longitude": 2.0})))
    good, bad = records.read_weather(spark, str(tmp_path))
    assert good.schema.fieldNames() == WEATHER_DAILY.fieldNames()
    assert rows(good.select("date", "latitude", "longitude", "temperature_2m_max", "temperature_2m_min", "wind_speed_10m_max"), "date") == [
        (D(2024, 1, 1), 46.0, 2.0, 10.0, 4.0, None), (D(2024, 1, 2), 46.0, 2.0, 12.0, None, None), (D(2024, 1, 3), 46.0, 2.0, 8.5, 2.0, None)]
    assert bad.count() == 2


@pytest.mark.parametrize("layout", ["lines", "array", "data"])
def test_station_records(spark, tmp_path, layout):
    recs = [{"reference_time": "2024-01-02T00:00:00Z", "TX": 253, "FFM": 50, "RR": -9999, "sid": "a"},
            {"DATE": "2024-01-01", "TX": "-9999", "TN": "12", "INST": 60}, {"TX": 1}, {"date": "2024-01-03"}]
    body = "\n".join(map(json.dumps, recs)) if layout == "lines" else json.dumps(recs if layout == "array" else {"data": recs})
    (tmp_path / "r.json").write_text(body)
    got = records.station_weather(records.read_station_records(spark, str(tmp_path), layout), 47.0, 0.0)
    assert got.columns[:3] == ["date", "latitude", "longitude"]
    assert rows(got.select("date", "longitude", "temperature_2m_max", "temperature_2m_min", "wind_speed_10m_max", "precipitation_sum", "sunshine_duration_min")) == [
        (D(2024, 1, 1), 0.0, None, 1.2, None, None, 60.0), (D(2024, 1, 2), 0.0, 25.3, None, 18.0, None, None), (D(2024, 1, 3), 0.0, None, None, None, None, None)]
    with pytest.raises(ValueError):
        records.station_weather(records.read_station_records(spark, str(tmp_path), layout).limit(0), 0, 0)


def test_stations(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([
        {"id": "a", "lat": 47.0, "lon": 0.0, "nom": "A"}, {"ID": 7, "latitude": "46", "Longitude": "1.5"}, {"id_station": "c", "Latitude": 1, "longitude": 2}]))
    got = records.read_stations(spark, str(tmp_path)).select("id_station", "latitude", "longitude")
    assert rows(got, "id_station") == [("7", 46.0, 1.5), ("a", 47.0, 0.0), ("c", 1.0, 2.0)]


WELL_RECORDS = [
    {"code_bss": "W-31/A", "x": 3.16, "y": 45.23, "altitude_station": "380.5", "profondeur_investigation": 64.0, "nb_mesures_piezo": 812,
     "codes_bdlisa": ["AQ7"], "noms_masse_eau_edl": ["Sables du plateau"]},
    {"code_bss": "W-12/B", "x": 3.11, "y": 45.19, "altitude_station": "412.5", "profondeur_investigation": 18.5, "nb_mesures_piezo": 95,
     "codes_bdlisa": ["AQ7", "Z"], "noms_masse_eau_edl": []},
    {"code_bss": "W-77/C", "x": 3.06, "y": 45.22, "altitude_station": None, "nb_mesures_piezo": 0, "codes_bdlisa": []},
    {"code_bss": "greenwich", "x": 0.0, "y": 45.2}, {"code_bss": "nowhere"}]


def test_wells(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"count": 3, "data": WELL_RECORDS}))
    wells = records.read_wells(spark, str(tmp_path), 45.2, 3.1, "data")
    got = by_distance(wells).collect()
    assert wells.columns == WELLS.fieldNames() and len(wells.columns) == 17
    assert [r.code_bss for r in got] == ["W-12/B", "W-77/C", "W-31/A", "greenwich", "nowhere"]
    assert all(r.distance_km < 10 for r in got[:3]) and got[3].distance_km > 60 and got[4].distance_km is None
    assert (got[0].code_bdlisa, got[0].nom_masse_eau, got[0].altitude_station, got[1].code_bdlisa) == ("AQ7", None, 412.5, None)


def test_groundwater(spark, tmp_path):
    recs = [{"code_bss": "b", "date_mesure": "2024-02-14", "profondeur_nappe": "11.75", "code_qualification": "1"},
            {"code_bss": "a", "date_mesure": "2024-01-08T00:00:00", "profondeur_nappe": 6.1, "code_qualification": 1},
            {"code_bss": "a", "date_mesure": "pas-une-date", "profondeur_nappe": "n.a.", "code_qualification": "invalide"}]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, recs)))
    got = records.read_groundwater(spark, str(tmp_path)).select("code_bss", "date_mesure", "profondeur_nappe", "code_qualification")
    assert rows(got, "code_bss", "date_mesure") == [("a", None, None, None), ("a", D(2024, 1, 8), 6.1, 1), ("b", D(2024, 2, 14), 11.75, 1)]


@pytest.mark.parametrize("layout", ["lines", "collection"])
def test_crop_parcels(spark, tmp_path, layout):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    feats = [
        {"properties": {"id_parcel": "P001", "code_cultu": "15", "surf_parc": 0.5}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"ID_PARCEL": "P002", "CODE_CULTU": "11", "SURF_PARC": 2.3}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}},
        {"properties": {"id_parcel": "P003", "code_cultu": "99", "surf_parc": 1.0}, "geometry": {"type": "Point", "coordinates": [0.0, 1.0]}},
        {"properties": {}, "geometry": None}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, feats)) if layout == "lines" else json.dumps({"features": feats}))
    features = records.read_features(spark, str(tmp_path), layout)
    got = rows(records.crop_parcel_rows(features), "id_parcel")
    assert [g[:4] for g in got] == [("", "", 0.0, "Inconnu"), ("P001", "15", 0.5, "Légumes ou fleurs"),
                                    ("P002", "11", 2.3, "Prairies permanentes"), ("P003", "99", 1.0, "Inconnu")]
    assert got[1][4].startswith("POLYGON((0.0 0.0") and got[2][4].startswith("MULTIPOLYGON(((") and got[0][4] == got[3][4] == ""
    assert records.features_in_box(features, 0.5, 1.2, 50).count() == 2 and records.features_in_box(features, 5.0, 1.2, 50).count() == 0


DOC = {"id": "p1", "nom": "Nord", "surface_ha": 2.5, "commune": "Sablé", "departement": "72", "coords_centroid": [47.85, -0.94],
       "prix_achat": 15000, "risque_gel_tardif": True, "date_creation": "2024-01-01T10:00:00",
       "date_modification": "2024-01-02 11:00:00"}


def test_parcel_documents(spark, tmp_path):
    bad = [dict(DOC, id="p2", surface_ha=-1.0, pente_pct=150), dict(DOC, id="p3", exposition="haut"), dict(DOC, id="p4", surface_ha="grand"),
           {k: v for k, v in DOC.items() if k != "nom"}]
    for i, doc in enumerate([DOC, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "broken.json").write_text("{not json")
    parcels = records.read_parcels(spark, str(tmp_path))
    errors = {r.fichier[-6:]: r.errors for r in parcels.collect()}
    assert errors == {"0.json": [], "1.json": ["surface_ha: outside 0.1..", "pente_pct: outside 0.0..100.0"],
                      "2.json": ["exposition: not one of N/NE/E/SE/S/SO/O/NO/plat"],
                      "3.json": ["surface_ha: wrong type", "surface_ha: required"], "4.json": ["nom: required"]}
    good = records.valid_parcels(parcels)
    row = good.first()
    assert (row.id, row.lat, row.lon, row.acces_eau, row.statut, row.risque_gel_tardif, row.date_creation) == (
        "p1", 47.85, -0.94, "inconnu", "prospect", True, dt.datetime(2024, 1, 1, 10))
    out = str(tmp_path / "out")
    records.write_parcels(good, out)
    back = records.valid_parcels(records.read_parcels(spark, out + "/*", "lines"))
    assert rows(back) == rows(good)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_table(spark, path) is None and not tables.table_exists(spark, path)
    assert tables.read_table(spark, path, WEATHER_DAILY).count() == 0
    make = lambda *r: spark.createDataFrame(r, "latitude double, longitude double, date date, rain double")
    keys = ["latitude", "longitude", "date"]
    tables.upsert_table(spark, path, make((1., 1., D(2024, 12, 31), 5.), (1., 1., D(2025, 1, 1), 6.)), keys)
    tables.upsert_table(spark, path, make((1., 1., D(2025, 1, 1), 9.), (1., 1., D(2025, 1, 2), None), (2., 1., D(2025, 1, 1), 1.)), keys)
    got = rows(spark.read.parquet(path).select("latitude", "date", "rain", "annee"), "latitude", "date")
    assert got == [(1., D(2024, 12, 31), 5., 2024), (1., D(2025, 1, 1), 9., 2025), (1., D(2025, 1, 2), None, 2025), (2., D(2025, 1, 1), 1., 2025)]
    pruned = filters.date_range(spark.read.parquet(path), D(2025, 1, 1), D(2025, 12, 31))
    assert "PartitionFilters: [isnotnull(annee" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() == 3
    log = str(tmp_path / "log")
    tables.append_rows(spark.range(2), log)
    tables.append_rows(spark.range(3), log)
    assert spark.read.parquet(log).count() == 5
    tables.write_all(spark.range(1), log)
    assert spark.read.parquet(log).count() == 1
    filled, absent = tables.with_missing_columns(spark.range(1).withColumn("date", F.current_date()), WEATHER_DAILY)
    assert "latitude" in absent and "date" not in absent and set(WEATHER_DAILY.fieldNames()) <= set(filled.columns)


def test_landed_sales_are_dealt_into_files_of_bounded_size(spark, monkeypatch):
    from queries import landing as landed

    monkeypatch.setattr(landed, "FILE_LINES", 60)
    sizes, before = [], landed._landed_files
    monkeypatch.setattr(landed, "_landed_files", lambda rows, *rest: (
        sizes.extend(len(r.lines) for r in rows.collect()), before(rows, *rest)))
    sf = "/root/testdata/sf0.001"
    got = {r.annee: (r.n, r.total) for r in landed.loaded_sales_job(spark, sf).select("annee", "n", "total").collect()}
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_retailprice").collect()
    assert sum(sizes) == 2 * len(parts) and max(sizes) <= 60 + 16
    wanted = {}
    for key, price in parts:
        n, total = wanted.get(2015 + key % 4, (0, 0.0))
        wanted[2015 + key % 4] = (n + 1, total + float(price // 1))
    assert got == {year: wanted[year] for year in (2015, 2016, 2017)}


def test_features_in_a_box_are_read_once(spark, tmp_path):
    """One reading of a feature and one of its shape decide, however many borders the box has."""
    ring = "[[[1.0,46.9],[1.2,46.9],[1.2,47.1],[1.0,46.9]]]"
    shapes = {"in": ("Polygon", ring), "out": ("Polygon", ring.replace("1.", "31.")), "several": ("MultiPolygon", f"[{ring}]"),
              "point": ("Point", "[1.0,47.0]"), "none": ("Polygon", "[]")}
    (tmp_path / "f.json").write_text("\n".join(
        f'{{"properties":{{"id_parcel":"{k}"}},"geometry":{{"type":"{t}","coordinates":{c}}}}}' for k, (t, c) in shapes.items()) + "\nno json\n")
    kept = records.features_in_box(records.read_features(spark, str(tmp_path / "f.json")), 47.0, 1.1, 20)
    assert sorted(r[0] for r in kept.select("properties.id_parcel").collect()) == ["in", "several"]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1 + 2 and plan.count("struct<properties") + plan.count("StructField(properties") <= 1
