import pytest
from pyspark.sql import functions as F

from glebe.functions import scoring as points
from glebe.operators import scoring
from glebe.schemas import PARCELS
from helpers import rows, values


def parcel(id, price, comparable, water, flow, market, access, slope, aspect, altitude, frost, rain, days):
    out = dict.fromkeys(PARCELS.fieldNames())
    out.update(id=id, nom=f"Parcelle {id}", surface_ha=2.0, commune="x", departement="72", lat=47.8, lon=-0.9,
               prix_achat=price, prix_comparable_eur_ha=comparable, acces_eau=water, debit_estime_m3h=flow,
               distance_marche_km=market, acces_vehicule=access, pente_pct=slope, exposition=aspect, altitude_m=altitude,
               risque_gel_tardif=frost, meteo_precip_annuelle_mm=rain, meteo_jours_gel=days, notes="")
    return tuple(out.values())


PARCEL_ROWS = [
    parcel("north_7", 12600., 14000., "riviere", None, 11., "facile", 2.4, "SE", 130., False, 520., 4),
    parcel("hill_3", 7700., 7000., "forage", 0.6, 24., "difficile", 17., "N", 310., True, 650., 12),
    parcel("dry_5", 5200., 8000., "aucun", None, 27., "facile", 6., "O", 220., False, 380., 7),
    parcel("best_1", 9000., 12500., "reseau", 4.0, 3., "facile", 0.9, "S", 90., False, 460., 2),
    parcel("plain_2", 15000., 15500., "forage", 2.2, 13., "limite", 3.5, "plat", 60., None, None, None),
]
# Worked out by hand from the bands: the three axes, then the global score under each of the scenarios below.
EXPECTED = {
    "north_7": (85, 79, 85, 82, 81, 83), "hill_3": (44, 58, 42, 48, 51, 46), "dry_5": (84, 31, 72, 61, 49, 64),
    "best_1": (98, 91, 89, 92, 92, 91), "plain_2": (71, 68, 78, 72, 70, 73),
}
SCENARIOS = {
    "standard": {"economique": 0.35, "eau": 0.35, "topographie": 0.30},
    "eau": {"economique": 0.2, "eau": 0.6, "topographie": 0.2},
    "topo": {"economique": 0.25, "eau": 0.25, "topographie": 0.5},
}


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(PARCEL_ROWS, PARCELS)


@pytest.mark.parametrize("score, pairs", [
    (lambda x: points.price_score(x, F.lit(1.0)), {0.8: 100, 0.9: 90, 0.95: 80, 1.0: 70, 1.1: 54, 1.2: 40, 1.3: 39, 6.: 0, 0.5: 130, None: 50}),
    (points.market_distance_score, {0.: 100, 5.: 90, 15.: 70, 30.: 40, 40.: 20, 50.: 0, 90.: 0, None: 50}),
    (points.slope_score, {0.5: 98, 3.: 90, 8.: 70, 15.: 40, 25.: 15, 35.: 0, None: 50}),
    (points.rain_score, {0.: 20, 250.: 60, 300.: 70, 400.: 86, 500.: 85, 600.: 86, 800.: 60, 1000.: 50, None: 50}),
    (lambda x: points.frost_score(F.lit(None).cast("boolean"), x), {0.: 80, 4.: 76, 5.: 70, 8.: 58, 10.: 50, 15.: 35, 20.: 20, 90.: 20, None: 70}),
    (points.altitude_score, {50.: 95, 150.: 85, 250.: 70, 400.: 50, 600.: 20, 1000.: 0, 2000.: 0, None: 65}),
])
def test_criteria(spark, score, pairs):
    assert values(spark, score(F.col("x")), list(pairs), "x double") == list(pairs.values())


def test_categories(spark):
    assert values(spark, points.vehicle_access_score(F.col("x")), ["facile", "limite", "difficile", "?", None], "x string") == [90, 60, 20, 50, 50]
    assert values(spark, points.water_access_score(F.col("x")), ["reseau", "riviere", "forage", "aucun", "inconnu", None], "x string") == [95, 75, 80, 5, 30, 30]
    assert values(spark, points.aspect_score(F.col("x")), ["S", "SE", "O", "NO", "N", "plat", None], "x string") == [90, 85, 75, 55, 35, 65, 50]
    flow = points.flow_adjustment(F.col("q"), F.col("a"))
    assert values(spark, flow, [(0.5, "forage"), (1.5, "forage"), (2.0, "forage"), (0.5, "riviere"), (None, "forage")], "q double, a string") == [-30, -10, 0, 0, 0]
    flag = points.frost_score(F.col("f"), F.lit(None).cast("int"))
    assert values(spark, flag, [True, False, None], "f boolean") == [40, 80, 70]
    assert values(spark, points.price_score(F.lit(5.0), F.lit(0.0)), [1], "x int") == [50]
    assert values(spark, points.price_score(F.lit(1.0), F.lit(10.0), clamp=True), [1], "x int") == [100]
    assert values(spark, points.mention(F.col("x")), [70, 69, 45, 44], "x int") == ["Favorable", "Mitigé", "Mitigé", "Défavorable"]


def test_scores(parcels):
    got = rows(scoring.score_scenarios(parcels, SCENARIOS).select(
        "id", "scenario", "score_economique", "score_eau", "score_topographie", "score_global"))
    for id, expected in EXPECTED.items():
        mine = {r[1]: r[2:] for r in got if r[0] == id}
        assert mine["standard"] == (*expected[:3], expected[3])
        assert (mine["eau"][3], mine["topo"][3]) == expected[4:]


def test_scenario_table(spark, parcels):
    table = spark.createDataFrame([(n, *w.values()) for n, w in SCENARIOS.items()],
                                  "scenario string, poids_economique double, poids_eau double, poids_topographie double")
    cols = ["id", "scenario", "score_global"]
    assert rows(scoring.score_scenarios(parcels, table).select(cols), "id", "scenario") == rows(
        scoring.score_scenarios(parcels, SCENARIOS).select(cols), "id", "scenario")
    wrong = table.withColumn("poids_eau", F.lit(0.1))
    with pytest.raises(Exception, match="sum to 1.0"):
        scoring.score_scenarios(parcels, wrong).collect()


def test_scenario_blocks_follow_the_counts(spark, parcels, monkeypatch):
    monkeypatch.setattr(scoring, "SCENARIO_BLOCK", 2)
    table = spark.range(9).select(F.col("id").cast("string").alias("scenario"), F.lit(0.3).alias("poids_economique"),
                                  F.lit(0.3).alias("poids_eau"), F.lit(0.4).alias("poids_topographie"))
    scored = scoring.score_scenarios(parcels.union(parcels), table)
    assert scored.count() == 9 * 2 * parcels.count()
    assert scored.select("id", "scenario").distinct().count() == 9 * parcels.select("id").distinct().count()
    assert scoring.score_scenarios(parcels, table.filter("false")).count() == 0
    assert scoring.score_scenarios(parcels.filter("false"), table).count() == 0


def test_thousands_of_scenarios(spark, parcels):
    table = spark.range(2500).select(F.col("id").cast("string").alias("scenario"), (F.col("id") % 70 / 100).alias("poids_economique"),
                                     F.lit(0.3).alias("poids_eau"), (F.lit(0.7) - F.col("id") % 70 / 100).alias("poids_topographie"))
    scored = scoring.score_scenarios(parcels, table)
    assert scored.count() == 2500 * parcels.count() and scored.select("id", "scenario").distinct().count() == scored.count()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scenario_blocks_leave_the_task_of_their_file(spark, parcels, monkeypatch, tmp_path):
    monkeypatch.setattr(scoring, "SCENARIO_BLOCK", 2)
    parcels.coalesce(1).write.parquet(str(tmp_path / "parcels"))
    table = spark.range(40).select(F.col("id").cast("string").alias("scenario"), F.lit(0.3).alias("poids_economique"),
                                   F.lit(0.3).alias("poids_eau"), F.lit(0.4).alias("poids_topographie"))
    scored = scoring.score_scenarios(spark.read.parquet(str(tmp_path / "parcels")), table)
    assert scored.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_totals_score_each_combination_once(spark, parcels, monkeypatch):
    met = []
    pairs = scoring.under_scenarios

    def counted(scored, scenarios, own=None):
        met.append((scored.count(), scenarios.count()))
        return pairs(scored, scenarios, own)

    table = spark.range(600).select(F.col("id").cast("string").alias("scenario"), (F.col("id") % 30 / 100).alias("poids_economique"),
                                    F.lit(0.3).alias("poids_eau"), (F.lit(0.7) - F.col("id") % 30 / 100).alias("poids_topographie"))
    many = parcels.withColumn("id", F.explode(F.array(*(F.concat("id", F.lit(f"-{i}")) for i in range(20)))))
    each = scoring.score_scenarios(many, table).groupBy("id").agg(
        F.count("*").alias("n_scenarios"), F.sum("score_global").alias("total"), F.min("score_global").alias("lowest"),
        F.max("score_global").alias("highest"))
    monkeypatch.setattr(scoring, "under_scenarios", counted)
    totals = scoring.scenario_totals(many, table)
    assert met == [(len(EXPECTED), 30)]
    assert rows(totals.select(each.columns), "id") == rows(each, "id") and totals.count() == 20 * len(EXPECTED)
    assert totals.columns[:len(PARCELS)] == parcels.columns
    with pytest.raises(Exception, match="sum to 1.0"):
        scoring.scenario_totals(parcels, table.withColumn("poids_eau", F.lit(0.1))).collect()
    assert scoring.scenario_totals(parcels, table.filter("false")).count() == 0


def test_weights():
    with pytest.raises(ValueError):
        scoring.check_weights({"economique": 0.5, "eau": 0.3, "topographie": 0.1})
    assert scoring.normalized_weights({"economique": 1, "eau": 2, "topographie": 1}) == {"economique": .25, "eau": .5, "topographie": .25}


def test_rank_and_tables(parcels):
    scored = scoring.score_parcels(parcels)
    ranked = scoring.rank_scores(scored)
    assert {r.id: r.rang for r in ranked.collect()} == {"best_1": 1, "north_7": 2, "plain_2": 3, "dry_5": 4, "hill_3": 5}
    assert [r.ID for r in scoring.summary_table(scored).collect()] == ["best_1", "north_7", "plain_2", "dry_5", "hill_3"]
    wide = scoring.axis_table(scored, ["Parcelle north_7", "Parcelle plain_2"])
    assert sorted(tuple(r) for r in wide.collect()) == [("Eau", 79, 68), ("Topographie", 85, 78), ("Économique", 85, 71)]
    criteria = scoring.criteria_rows(scored).filter("id = 'north_7'")
    assert criteria.count() == 9
    assert tuple(criteria.filter("critere = 'Distance Marche'").first())[2:] == ("Économique", "Distance Marche", 78, "Favorable")
    assert {r.axe: r.id for r in scoring.best_per_axis(scored).collect()} == {"Économique": "best_1", "Eau": "best_1", "Topographie": "best_1"}
    report = scoring.report_rows(scored).filter("id = 'plain_2'").first()
    assert report.axes[1].criteres == {"acces_eau": 80, "precipitation": 50} and report.identite.commune == "x"
    assert [r.id for r in scoring.choose(parcels, ["plain_2", "dry_5"]).collect()] == ["dry_5", "plain_2"]


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("s", "a", 5), ("s", "b", 5), ("s", "c", 4), ("t", "a", 1)], "scenario string, id string, score_global int")
    got = {(r.scenario, r.id): r.rang for r in scoring.rank_scores(df, ["scenario"]).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 1, ("s", "c"): 3, ("t", "a"): 1}


@pytest.mark.parametrize("axes, weights, expected", [
    ((30, 90, 30), (0.35, 0.35, 0.30), 51), ((30, 90, 30), (0.15, 0.70, 0.15), 72),
    ((90, 30, 30), (0.35, 0.35, 0.30), 51), ((90, 30, 30), (0.15, 0.70, 0.15), 39)])
def test_weighting(spark, axes, weights, expected):
    df = spark.createDataFrame([axes], "score_economique int, score_eau int, score_topographie int")
    assert df.select(scoring._global(dict(zip(scoring.DEFAULT_WEIGHTS, weights)))).first()[0] == expected
