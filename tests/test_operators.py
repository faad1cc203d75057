import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from glebe.operators import conform, enrichment, filters, hours, latest, market_gap, prices, summaries, validate
from glebe.operators.quantiles import group_quantiles
from glebe.schemas import PARCELS
from helpers import plan_of, rows

D = dt.date


# ---- quantiles --------------------------------------------------------------------------------------


@pytest.mark.parametrize("method, builtin", [("linear", "percentile_cont"), ("disc", "percentile_disc")])
def test_group_quantiles(spark, method, builtin):
    rng = random.Random(1)
    data = [("hot", rng.choice([rng.uniform(-5, 5), rng.uniform(0, 1e9), 1.25])) for _ in range(2000)]
    data += [("one", 3.5), ("two", -1.0), ("two", 4.0), (None, 2.0), (None, 8.0), ("two", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in group_quantiles(df, ["g"], "v", probs, method).collect()}
    exact = ", ".join(f"{builtin}({p}) within group (order by v) {n}" for n, p in probs.items())
    df.createOrReplaceTempView("q")
    expected = {r.g: tuple(r)[1:] for r in spark.sql(f"select g, count(v) n, {exact} from q where v is not null group by g").collect()}
    assert set(got) == set(expected)
    for g in got:
        assert got[g] == pytest.approx(expected[g], rel=1e-12)


def test_weighted_and_global_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2)], "v double, w int")
    got = group_quantiles(df, [], "v", {"m": 0.5}, "linear", weight="w").first()
    assert (got.n, got.m) == (6, statistics.median([1, 1, 1, 5, 9, 9]))
    assert group_quantiles(df, [], "v", {"m": 0.6}, "nearest").first().m == 5.0
    with pytest.raises(ValueError):
        group_quantiles(df, [], "v", {"m": 1.5})


# ---- merge and refresh ------------------------------------------------------------------------------


def weather(spark, *r):
    return spark.createDataFrame(r, "latitude double, longitude double, date date, temperature_2m_max double, precipitation_sum double")


def test_upsert(spark):
    old = weather(spark, (1., 1., D(2026, 3, 20), 15., 0.), (1., 1., D(2026, 3, 21), 16., 1.), (2., 1., D(2026, 3, 21), 7., 7.))
    new = weather(spark, (1., 1., D(2026, 3, 21), 18.5, None), (1., 1., D(2026, 3, 22), 19., 0.)).withColumn("extra", F.lit(1))
    once = latest.upsert(old, new)
    got = rows(once.select("latitude", "date", "temperature_2m_max", "precipitation_sum", "extra"), "latitude", "date")
    assert got == [(1., D(2026, 3, 20), 15., 0., None), (1., D(2026, 3, 21), 18.5, None, 1), (1., D(2026, 3, 22), 19., 0., 1),
                   (2., D(2026, 3, 21), 7., 7., None)]
    assert rows(latest.upsert(once, new), "latitude", "date") == rows(once, "latitude", "date")
    assert latest.upsert(None, old).count() == 3


def test_refresh_plan(spark):
    points = spark.createDataFrame([(1., 1.), (2., 2.), (3., 3.)], "latitude double, longitude double")
    old = weather(spark, (1., 1., D(2026, 3, 22), 1., 1.), (3., 3., D(2021, 1, 1), 1., 1.))
    plan = latest.refresh_plan(points, old, D(2026, 4, 4), 5, 10).select("latitude", "debut", "fin", "mode")
    assert rows(plan, "latitude") == [(1., D(2026, 3, 12), D(2026, 4, 4), "incremental"), (2., D(2022, 1, 1), D(2026, 4, 4), "full"),
                                      (3., D(2022, 1, 1), D(2026, 4, 4), "incremental")]
    forced = latest.refresh_plan(points, old, D(2026, 4, 4), 5, 10, force_full=True)
    assert {r.debut for r in forced.collect()} == {D(2022, 1, 1)}


# ---- conform ----------------------------------------------------------------------------------------


def test_year_fill(spark):
    q = spark.createDataFrame([("a", 2020, None, 9), ("a", None, "2021", 9), ("b", None, "08/01/2026", 9), ("b", None, "x", 9),
                               ("c", None, None, 2019)], "_file string, annee int, date string, _file_year int")
    assert rows(conform.fill_quote_year(q).select("_file", "annee"), "_file", F.col("annee").asc_nulls_first()) == [
        ("a", None), ("a", 2020), ("b", None), ("b", 2026), ("c", 2019)]


def test_concat_and_labels(spark):
    a, b = spark.createDataFrame([(1, "x")], "v int, s string"), spark.createDataFrame([(2.5, True)], "v double, z boolean")
    assert rows(conform.concat([a, b], relaxed=True).select("v", "s", "z"), "v") == [(1.0, "x", None), (2.5, None, True)]
    codes = spark.createDataFrame([("15", "Légumes")], "code string, libelle string")
    df = spark.createDataFrame([("15",), ("9",)], "code_culture string")
    got = conform.with_label(df, codes.withColumnRenamed("code", "code_culture"), "code_culture", "libelle", "Inconnu")
    assert rows(got, "code_culture") == [("15", "Légumes"), ("9", "Inconnu")]


def test_display_weather(spark):
    grid = spark.createDataFrame([(D(2024, 1, 1), 1.0, 2.0)], "date date, temperature_2m_max double, shortwave_radiation_sum double")
    station = spark.createDataFrame([(D(2024, 1, 2), 3.0, 4.0)], "date date, temperature_2m_max double, sunshine_duration_min double")
    got = conform.both_sources(grid, station)
    assert rows(got.select("date", "source", "t_max", "rayonnement_mj", "ensoleillement_min"), "date") == [
        (D(2024, 1, 1), "grille", 1.0, 2.0, None), (D(2024, 1, 2), "station", 3.0, None, 4.0)]


# ---- enrichment -------------------------------------------------------------------------------------

DAYS = [(D(2024, 1, 1), 47.85, -0.94, 10., 1., -2.), (D(2024, 1, 2), 47.85, -0.94, 20., 2., 2.),
        (D(2025, 1, 1), 47.85, -0.94, 30., 3., -1.), (D(2025, 1, 2), 47.85, -0.94, 40., 4., 5.), (D(2025, 1, 2), 44., 3., 400., 4., 5.)]


@pytest.fixture(scope="module")
def context(spark):
    base = dict.fromkeys(PARCELS.fieldNames()) | dict(id="p", nom="P", surface_ha=2.0, commune="x", departement="72", lat=47.85, lon=-0.94)
    parcels = spark.createDataFrame([tuple(base.values()), tuple((base | dict(id="q", meteo_jours_gel=9, lat=10.0)).values())], PARCELS)
    days = spark.createDataFrame(DAYS, "date date, latitude double, longitude double, precipitation_sum double, et0_fao_evapotranspiration double, temperature_2m_min double")
    sales = spark.createDataFrame([(12000., 10000., 47.8505, -0.9405), (18000., 15000., 48.20, 0.10), (1., 0., 47.85, -0.94), (1., None, 47.85, -0.94)],
                                  "valeur_fonciere double, surface_terrain double, latitude double, longitude double")
    wells = spark.createDataFrame([(47.851, -0.941), (48.5, 0.2), (None, 1.0)], "latitude double, longitude double")
    return parcels, days, sales, wells


def test_enrich(context):
    parcels, days, sales, wells = context
    out = enrichment.enrich(parcels, days, sales, wells, sale_radius_km=10)
    got = {r.id: r for r in out.collect()}
    p, d = got["p"], got["p"].diagnostics
    assert (p.meteo_precip_annuelle_mm, p.meteo_etp_annuelle_mm, p.meteo_jours_gel, p.prix_comparable_eur_ha, p.forages_brgm_count) == (50.0, 5.0, 1, 12000.0, 1)
    assert (d.weather_years, d.weather_latitude, d.dvf_transactions, d.bss_stations, d.warnings) == (2, 47.85, 1, 1, []) and d.nearest_bss_km < 1
    q = got["q"]
    assert (q.meteo_jours_gel, q.prix_comparable_eur_ha, q.forages_brgm_count, q.diagnostics.warnings) == (9, None, 0, [enrichment.NO_SALE])
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    over = enrichment.enrich(parcels, days, sales, wells, overwrite=True).filter("id = 'q'").first()
    assert over.meteo_jours_gel == 0


def test_enrich_without_tables(context):
    parcels, days, sales, wells = context
    got = enrichment.enrich(parcels, None, sales.drop("surface_terrain"), None).filter("id = 'p'").first()
    assert got.prix_comparable_eur_ha is None and got.forages_brgm_count is None
    assert got.diagnostics.warnings == [enrichment.NO_WEATHER_TABLE, enrichment.NO_LAND_AREA, enrichment.NO_WELLS_TABLE]
    no_rain = days.withColumn("precipitation_sum", F.lit(None).cast("double"))
    dry = enrichment.enrich(parcels, no_rain, sales, wells).filter("id = 'p'").first()
    assert dry.meteo_jours_gel is None and enrichment.NO_WEATHER in dry.diagnostics.warnings


def test_normals(context):
    _, days, _, _ = context
    assert enrichment.climate_normals(days, min_days_per_year=2).count() == 1
    kept = days.select("latitude", "longitude").limit(1)
    assert enrichment.weather_of_points(days, kept).count() == 4


def test_validation(spark, context):
    parcels = context[0]
    bad = parcels.withColumns({"id": F.concat("id", F.lit("x")), "surface_ha": F.lit(-1.0), "pente_pct": F.lit(150.0), "statut": F.lit("vendu")})
    valid, quarantine = validate.split_parcels(parcels.unionByName(bad))
    assert valid.count() == 2 and valid.first().acces_vehicule == "facile" and valid.first().date_creation is not None
    assert [len(r.errors) for r in quarantine.collect()] == [3, 3]


# ---- prices -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def quotes(spark):
    rng = random.Random(4)
    start = D(2024, 1, 1)
    data = [(2024, (start + dt.timedelta(days=rng.randrange(90))).strftime("%d/%m/%Y") if rng.random() > .05 else "?", p, rng.choice(["RUNGIS", "NANTES"]), "GROS", "KG",
             1.0, round(rng.uniform(.5, 4), 2), 5.0) for p in ("TOMATE RONDE", "TOMATE CERISE", "AIL") for _ in range(rng.randrange(40, 90))]
    data += [(2024, "01/02/2024", "UNIQUE", "RUNGIS", "GROS", "KG", 1.0, 2.0, 3.0), (2024, "01/02/2024", "NUL", "RUNGIS", "GROS", "KG", 1.0, None, 3.0)]
    return spark.createDataFrame(data, "annee int, date string, produit string, marche string, stade string, unite string, prix_min double, prix_moyen double, prix_max double")


def test_price_trend(quotes):
    shown = prices.display_quotes(quotes)
    got = {r.produit: tuple(r)[1:] for r in prices.price_trend(shown, ["produit"]).collect()}
    by = {}
    for r in shown.collect():
        by.setdefault(r.produit, []).append(((r.date_cot is None, r.date_cot or D(1, 1, 1)), r.prix_moyen))
    assert set(got) == set(by) and "NUL" not in by
    for product, series in by.items():
        ordered = [p for _, p in sorted(series)]
        k = max(1, len(ordered) // 10)
        first, last = sum(ordered[:k]) / k, sum(ordered[-k:]) / k
        assert got[product] == pytest.approx((round(first, 3), round(last, 3), round((last - first) / first * 100, 1)), abs=0.051)
    everything = shown.withColumn("_all", F.lit(0))
    assert prices.price_trend(everything, ["_all"]).count() == 1


def test_price_tables(quotes):
    shown = prices.display_quotes(quotes)
    assert prices.selector_values(shown, "famille").collect()[0].famille == "AIL"
    tomatoes = prices.select_quotes(shown, family="TOMATE")
    assert {r.produit for r in tomatoes.select("produit").distinct().collect()} == {"TOMATE RONDE", "TOMATE CERISE"}
    wide = prices.price_series_wide(shown, ["AIL", "TOMATE RONDE"], "month")
    assert wide.columns == ["periode", "AIL", "TOMATE RONDE"]
    long = {(r.produit, r.periode): r.prix_moy for r in prices.price_series(shown, "month").collect()}
    for r in wide.collect():
        assert r["AIL"] == long.get(("AIL", r.periode))
    dist = {r.produit: r for r in prices.price_distribution(shown).collect()}
    ail = sorted(r.prix_moyen for r in shown.filter("produit = 'AIL'").collect())
    assert dist["AIL"].n_cotations == len(ail) and dist["AIL"].mediane == pytest.approx(statistics.median(ail), abs=1e-3)
    assert dist["UNIQUE"].p25 == dist["UNIQUE"].prix_max == 2.0 and dist["UNIQUE"].unite == "KG"
    season = prices.seasonality_wide(shown)
    assert season.columns[1:4] == ["Jan", "Fév", "Mar"] and season.filter("produit = 'UNIQUE'").first()["Fév"] == 2.0
    assert prices.seasonality(shown).filter("produit = 'UNIQUE'").first().mois_label == "Fév"
    table = prices.latest_quotes(shown, 5).collect()
    assert len(table) == 5 and table[0].Date == max(r.date_cot for r in shown.collect() if r.date_cot)
    assert prices.selection_metrics(shown).first().n_cotations == shown.count()


# ---- hours ------------------------------------------------------------------------------------------


def test_hours(spark):
    log = spark.createDataFrame([("a", "2024-01-01", "", "", "2.5", "semis", "", "manuel"), ("b", "x", "", "", "y", None, "", "manuel")],
                                "id string, date string, debut string, fin string, duree_h string, poste string, notes string, source string")
    typed = hours.typed_hours(log)
    assert rows(typed.select("id", "date", "duree_h", "annee", "semaine", "jour_semaine"), "id") == [
        ("a", D(2024, 1, 1), 2.5, 2024, 1, 1), ("b", None, None, None, None, None)]
    assert tuple(summaries.hours_summary(typed).first()) == (2, 2.5, D(2024, 1, 1), D(2024, 1, 1), 1)
    assert [tuple(r) for r in summaries.hours_per_task(typed).collect()] == [("semis", 1, 2.5), (None, 1, None)]
    asked = spark.createDataFrame([("1", "semis", "2h30", "hier", None), ("2", "semis", "deux", "hier", None), ("3", "semis", "90min", "", "n"), ("4", "x", "1h", "demain", None)],
                                  "id string, poste string, duree string, jour string, notes string")
    got = rows(hours.entries_from_text(asked, D(2026, 4, 1)).select("id", "date", "duree_h", "error"), "id")
    assert got == [("1", D(2026, 3, 31), 2.5, None), ("2", D(2026, 3, 31), None, "duree"), ("3", D(2026, 4, 1), 1.5, None), ("4", None, 1.0, "jour")]
    assert [r.id for r in hours.last_entries(typed, 1).collect()] == ["a"]


def test_timer_pairs(spark):
    at = lambda *a: dt.datetime(*a)
    ev = spark.createDataFrame([
        ("w", at(2024, 1, 5, 8), "start", "a"), ("w", at(2024, 1, 5, 9, 30), "stop", "a"), ("w", at(2024, 1, 5, 10), "start", "b"),
        ("w", at(2024, 1, 5, 11), "start", "c"), ("w", at(2024, 1, 5, 11, 15), "stop", "c"), ("w", at(2024, 1, 6, 1), "stop", "c"),
        ("w", at(2024, 1, 31, 23), "start", "night"), ("w", at(2024, 2, 1, 1), "stop", "night"), ("w", at(2024, 2, 2, 1), "start", "open"),
        ("v", at(2024, 1, 31, 23), "start", "gap"), ("v", at(2024, 4, 1, 0), "stop", "gap")], "worker string, ts timestamp_ntz, kind string, poste string")
    got = rows(hours.hours_from_timer(ev).select("worker", "poste", "debut", "fin", "duree_h"), "worker", "date", "debut")
    assert got == [("v", "gap", "23:00", "00:00", 1441.0), ("w", "a", "08:00", "09:30", 1.5), ("w", "c", "11:00", "11:15", 0.25),
                   ("w", "night", "23:00", "01:00", 2.0)]


def test_timer_pairs_across_blocks(spark, monkeypatch):
    """A shared badge, cut into blocks of a few events, against one walk through the sorted events."""
    draw, start = random.Random(3), dt.datetime(2024, 1, 31, 20)
    events = [(draw.choice(["badge", "badge", "badge", "w", None]), start + dt.timedelta(minutes=draw.randrange(3000)),
               draw.choice(["start", "stop"]), draw.choice("abc")) for _ in range(600)] + [("w", None, "start", "a")]
    want = []
    for worker in {e[0] for e in events}:
        own = sorted(e[1:] for e in events if e[0] == worker and e[1] is not None)
        want += [(worker, t, a, round((b - a).total_seconds() / 3600 + 1e-9, 2)) for (a, k, t), (b, after, _) in zip(own, own[1:])
                 if k == "start" and after == "stop"]
    given = spark.createDataFrame(events, "worker string, ts timestamp_ntz, kind string, poste string")
    for size in (1, 7, 100_000):
        monkeypatch.setattr(hours, "TIMER_BLOCK", size)
        got = hours.hours_from_timer(given, seconds=True).collect()
        assert sorted((str(r.worker), r.poste, f"{r.date} {r.debut}", r.duree_h) for r in got) == sorted(
            (str(w), t, f"{a:%Y-%m-%d %H:%M}", h) for w, t, a, h in want)


# ---- summaries, filters, market gap -----------------------------------------------------------------


def test_status(spark):
    ref = D(2026, 4, 4)
    df = spark.createDataFrame([(D(2026, 4, 2),), (D(2026, 3, 1),)], "date date")
    status = lambda d, name: tuple(summaries.source_status(d, name, F.col("date"), ref).first())
    assert status(df, "meteo") == ("meteo", D(2026, 4, 2), 2, 2, summaries.FRESH, None)
    assert status(df.filter("date < '2026-04-01'"), "prix") == ("prix", D(2026, 3, 1), 34, 1, summaries.OLD, "Pas d'update depuis 34 jours")
    assert status(df.limit(0), "rpg")[3:] == (0, summaries.FAILED, "Pas d'update depuis None jours")
    assert tuple(summaries.failed_source(spark, "x", "e" * 80).first()) == ("x", None, None, 0, summaries.FAILED, "e" * 50)
    assert tuple(summaries.date_span(df).first()) == (D(2026, 3, 1), D(2026, 4, 2))


def test_recent_measures(spark):
    g = spark.createDataFrame([("a", D(2024, 3, 1), 1.234, 2.0, "Bonne"), ("a", D(2024, 3, 20), 1., 2., "Bonne"), ("b", D(2023, 1, 1), 1., 2., None)],
                              "code_bss string, date_mesure date, profondeur_nappe double, niveau_eau_ngf double, qualification string")
    got = rows(filters.recent_measures(g, D(2024, 4, 1), 90))
    assert [(r[0], r[1], r[2]) for r in got] == [("a", D(2024, 3, 20), 1.0), ("a", D(2024, 3, 1), 1.23)]


def test_market_gap(spark):
    a = spark.createDataFrame([("Ferme A", "Laval", "53000", "oeufs| miel")], "Nom string, Commune string, `Code Postal` string, type_produit string")
    b = spark.createDataFrame([("Ferme A", "Laval", "autre"), ("Ferme B", "Craon", "miel")], "nom string, commune string, type_produit string")
    both = market_gap.consolidate({"a.csv": a, "b.csv": b})
    assert rows(both.select("nom", "commune", "source", "type_produit"), "nom") == [("Ferme A", "Laval", "a.csv", "oeufs| miel"), ("Ferme B", "Craon", "b.csv", "miel")]
    assert rows(market_gap.product_matrix(both)) == [("oeufs", 1, "Laval"), ("miel", 2, "Craon, Laval")]
    reg = spark.createDataFrame([("53000", "56.10A", "A"), ("53000", "56.10A", "F"), ("72000", "56.10A", "A"), ("53100", "01.13Z", "A")], "code_postal string, activite string, etat string")
    assert market_gap.active_businesses(reg, "53").count() == 1
    zones = spark.createDataFrame([("Laval", 4, 20000.0), ("Craon", 0, None), ("Vide", 1, 10000.0)], "commune string, nb_restaurants int, MED20 double")
    counted = market_gap.count_in_zones(both, zones, "commune", ["miel", "oeufs"])
    assert rows(counted.select("commune", "nb_miel", "nb_oeufs"), "commune") == [("Craon", 1, 0), ("Laval", 1, 1), ("Vide", 0, 0)]
    scored = market_gap.opportunity(counted, "nb_restaurants", "MED20", "nb_miel")
    assert rows(scored.select("commune", "score"), "commune") == [("Craon", 0.0), ("Laval", 3.0), ("Vide", 4.5)]
    scaled = market_gap.scale_to_ten(scored, "score", "norm")
    assert rows(scaled.select("commune", F.round("norm", 3)), "commune") == [("Craon", 0.0), ("Laval", 6.667), ("Vide", 10.0)]
    assert [r.commune for r in market_gap.top_share(scaled, "norm", "commune", 0.5).collect()] == ["Vide", "Laval"]
    assert market_gap.scale_to_ten(zones.withColumn("c", F.lit(1.0)), "c", "norm").first().norm is None
    income = spark.createDataFrame([("Craon", 1.0)], "code string, revenu double")
    assert rows(market_gap.with_income(zones, income, "commune", "code", "revenu").select("commune", "revenu"), "commune")[0] == ("Craon", 1.0)


def test_coverage(spark):
    cells = spark.createDataFrame([("c1", "z", 10, 47.0, 0.0), ("c2", "z", 5, 48.0, 0.0), ("c3", "y", 7, 47.01, 0.0)], "cell string, zone string, pop int, lat double, lon double")
    prod = spark.createDataFrame([(47.0, 0.01), (47.0, 0.01)], "latitude double, longitude double")
    assert rows(market_gap.uncovered(cells, prod, 10, "zone", "pop", "cell")) == [("z", 5, 1)]
    assert rows(market_gap.density(cells, prod).select("cell", "n"), "cell") == [("c1", 2), ("c2", 0), ("c3", 2)]


def test_crowded_areas(spark):
    """Blocks of spots give the same counts, distances and medians as all pairs."""
    from glebe.operators.spatial import radius_parts
    from glebe.operators.tree import build
    from test_spatial import km

    rng = random.Random(8)
    town = [(47 + rng.gauss(0, .05), rng.gauss(0, .05), round(rng.uniform(1, 1e4), rng.choice([0, 2]))) for _ in range(5000)]
    spread = [(47 + rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(1, 1e4)) for _ in range(200)]
    spots = spark.createDataFrame([(*s, i % 3 + 1) for i, s in enumerate(town + spread)], "latitude double, longitude double, prix double, copies int")
    at = [(47 + rng.gauss(0, .15), rng.gauss(0, .15)) for _ in range(40)] + [(47.8, .9), (10., 10.)]
    places = spark.createDataFrame(at, "lat double, lon double")
    tree = build(spots, weight="copies")
    parts = radius_parts(places, tree, 12.0)
    expected = {}
    for a in at:
        hits = [(km(*a, *s[:2]), s[2], i % 3 + 1) for i, s in enumerate(town + spread) if km(*a, *s[:2]) <= 12]
        if hits:
            expected[a] = (sum(h[2] for h in hits), statistics.median([v for _, v, c in hits for _ in range(c)]), min(h[0] for h in hits))
    n_pairs = sum(1 for a in at for s in town + spread if km(*a, *s[:2]) <= 12)
    assert parts.pairs.count() + parts.blocks.count() < n_pairs / 2
    medians = {(r.lat, r.lon): r for r in enrichment.median_within(places, tree, 12.0, "prix", "copies").collect()}
    counts = {(r.lat, r.lon): r for r in enrichment.count_within(places, tree, 12.0, "copies").collect()}
    assert set(medians) == set(counts) == set(expected)
    for a, (n, median, closest) in expected.items():
        assert medians[a].n == counts[a].n == n
        assert medians[a].prix == pytest.approx(median)
    wells = spots.select("latitude", "longitude", "copies").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    found = enrichment._wells_at(places, wells, 12.0).collect()
    assert {(r.lat, r.lon) for r in found} == set(expected)
    for r in found:
        n, _, closest = expected[r.lat, r.lon]
        assert r.n_wells == n and r.nearest_km == pytest.approx(closest, abs=1e-9)


def test_the_year_of_a_file_reaches_its_rows_without_a_shuffle(spark):
    """Rows of one large file stay in the tasks that read them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quotes = spark.range(4000, numPartitions=4).select(
            F.lit(None).cast("int").alias("annee"), F.lit("03/02/2019").alias("date"), F.lit("a.csv").alias("_file"), F.lit(2018).alias("_file_year"))
        filled = conform.fill_quote_year(quotes).select("annee", F.spark_partition_id().alias("task"))
        assert filled.groupBy("task").count().count() == 4
        assert filled.select("annee").distinct().collect() == [(2019,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
