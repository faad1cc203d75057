"""Criteria, axes, global scores, ranks, comparison tables, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from glebe.operators import scoring, validate
from queries.registry import query
from queries.standins import standin, table, with_tables

_RATIO = "(prix_achat / prix_comparable_eur_ha)"
CRITERIA_SQL = {
    "prix_achat": f"""CASE WHEN prix_achat IS NULL OR prix_comparable_eur_ha IS NULL THEN 50
      WHEN {_RATIO} <= 0.9::DOUBLE THEN trunc(90 + (0.9::DOUBLE - {_RATIO}) / 0.1::DOUBLE * 10)
      WHEN {_RATIO} <= 1 THEN trunc(70 + (1.0::DOUBLE - {_RATIO}) / 0.1::DOUBLE * 20)
      WHEN {_RATIO} <= 1.2::DOUBLE THEN trunc(40 + (1.2::DOUBLE - {_RATIO}) / 0.2::DOUBLE * 30)
      ELSE greatest(0, trunc(40 - ({_RATIO} - 1.2::DOUBLE) * 10)) END""",
    "distance_marche": """CASE WHEN distance_marche_km IS NULL THEN 50
      WHEN distance_marche_km <= 5 THEN trunc(90 + least(10, (5 - distance_marche_km) / 5 * 10))
      WHEN distance_marche_km <= 15 THEN trunc(70 + (15 - distance_marche_km) / 10 * 20)
      WHEN distance_marche_km <= 30 THEN trunc(40 + (30 - distance_marche_km) / 15 * 30)
      ELSE greatest(0, trunc(40 - (distance_marche_km - 30) / 20 * 40)) END""",
    "acces_vehicule": "CASE acces_vehicule WHEN 'facile' THEN 90 WHEN 'limite' THEN 60 WHEN 'difficile' THEN 20 ELSE 50 END",
    "acces_eau": """greatest(0, least(100, CASE acces_eau WHEN 'reseau' THEN 95 WHEN 'riviere' THEN 75 WHEN 'forage' THEN 80 WHEN 'aucun' THEN 5 ELSE 30 END
      + CASE WHEN acces_eau = 'forage' AND debit_estime_m3h < 1 THEN -30 WHEN acces_eau = 'forage' AND debit_estime_m3h < 2 THEN -10 ELSE 0 END))""",
    "precipitation": """CASE WHEN meteo_precip_annuelle_mm IS NULL THEN 50
      WHEN meteo_precip_annuelle_mm BETWEEN 400 AND 600 THEN trunc(85 + least(5, abs(500 - meteo_precip_annuelle_mm) / 100))
      WHEN meteo_precip_annuelle_mm BETWEEN 300 AND 700 THEN trunc(70 + least(abs(300 - meteo_precip_annuelle_mm), abs(700 - meteo_precip_annuelle_mm)) / 150)
      WHEN meteo_precip_annuelle_mm >= 200 AND meteo_precip_annuelle_mm < 300 THEN trunc(50 + (meteo_precip_annuelle_mm - 200) / 100 * 20)
      WHEN meteo_precip_annuelle_mm > 700 AND meteo_precip_annuelle_mm <= 900 THEN trunc(50 + (900 - meteo_precip_annuelle_mm) / 200 * 20)
      ELSE greatest(20, trunc(least(50, meteo_precip_annuelle_mm / 10))) END""",
    "pente": """CASE WHEN pente_pct IS NULL THEN 50 WHEN pente_pct <= 3 THEN trunc(90 + least(10, (3 - pente_pct) / 3 * 10))
      WHEN pente_pct <= 8 THEN trunc(70 + (8 - pente_pct) / 5 * 20) WHEN pente_pct <= 15 THEN trunc(40 + (15 - pente_pct) / 7 * 30)
      WHEN pente_pct <= 25 THEN trunc(15 + (25 - pente_pct) / 10 * 25) ELSE greatest(0, trunc(15 - (pente_pct - 25) / 10 * 15)) END""",
    "exposition": "CASE exposition WHEN 'S' THEN 90 WHEN 'SE' THEN 85 WHEN 'SO' THEN 85 WHEN 'E' THEN 75 WHEN 'O' THEN 75 WHEN 'NE' THEN 55 WHEN 'NO' THEN 55 WHEN 'N' THEN 35 WHEN 'plat' THEN 65 ELSE 50 END",
    "risque_gel": """CASE WHEN meteo_jours_gel < 5 THEN trunc(75 + least(5, (5 - meteo_jours_gel) / 5 * 5)) WHEN meteo_jours_gel <= 10 THEN trunc(50 + (10 - meteo_jours_gel) / 5 * 20)
      WHEN meteo_jours_gel IS NOT NULL THEN greatest(20, trunc(50 - (meteo_jours_gel - 10) / 10 * 30)) WHEN risque_gel_tardif IS NULL THEN 70 WHEN risque_gel_tardif THEN 40 ELSE 80 END""",
    "altitude": """CASE WHEN altitude_m IS NULL THEN 65 WHEN altitude_m <= 150 THEN trunc(85 + least(10, (150 - altitude_m) / 100 * 10))
      WHEN altitude_m <= 250 THEN trunc(70 + (250 - altitude_m) / 100 * 15) WHEN altitude_m <= 400 THEN trunc(50 + (400 - altitude_m) / 150 * 20)
      WHEN altitude_m <= 600 THEN trunc(20 + (600 - altitude_m) / 200 * 30) ELSE greatest(0, trunc(20 - (altitude_m - 600) / 400 * 20)) END""",
}


def _axis_sql(members: dict[str, float]) -> str:
    return "trunc(" + " + ".join(f"critere_{c} * {w}::DOUBLE" for c, w in members.items()) + ")::INT"


AXES_SQL = ("criteria AS (SELECT *, " + ", ".join(f"CAST({sql} AS INT) AS critere_{c}" for c, sql in CRITERIA_SQL.items()) + " FROM parcels), "
            "axes AS (SELECT *, " + ", ".join(f"{_axis_sql(m)} AS score_{a}" for a, m in scoring.AXIS_CRITERIA.items()) + " FROM criteria)")


def global_sql(weights) -> str:
    return "trunc(" + " + ".join(f"score_{a} * {weights[a]}" for a in scoring.DEFAULT_WEIGHTS) + ")::INT"


GLOBAL_SQL = global_sql({a: f"{w}::DOUBLE" for a, w in scoring.DEFAULT_WEIGHTS.items()})
SCORED = with_tables("parcels") + f", {AXES_SQL}, scored AS (SELECT *, {GLOBAL_SQL} AS score_global FROM axes)"


def rank_sql(partition: str = "", score: str = "score_global") -> str:
    return f"CAST(rank() OVER ({partition} ORDER BY {score} DESC) AS INT)"


def _scored(spark, sf):
    return scoring.score_parcels(standin(spark, sf, "parcels"))


CRITERIA = [f"critere_{c}" for c in CRITERIA_SQL]


@query(SCORED + f" SELECT id, {', '.join(CRITERIA)} FROM axes")
def parcel_criteria(spark, sf):
    return scoring.score_axes(standin(spark, sf, "parcels")).select("id", *CRITERIA)


@query(SCORED + " SELECT id, score_economique, score_eau, score_topographie FROM axes")
def axis_scores(spark, sf):
    return scoring.score_axes(standin(spark, sf, "parcels")).select("id", "score_economique", "score_eau", "score_topographie")


@query((with_tables("parcels") + f", {AXES_SQL} SELECT id, least(100, critere_prix_achat) AS critere_prix_achat FROM axes").replace(
    _RATIO, "(prix_achat / surface_ha / prix_comparable_eur_ha)"))
def price_criterion_per_ha(spark, sf):
    return scoring.score_axes(standin(spark, sf, "parcels"), price_basis="per_ha", clamp_price=True).select("id", "critere_prix_achat")


@query(SCORED + " SELECT id, score_global FROM scored")
def global_scores(spark, sf):
    return _scored(spark, sf).select("id", "score_global")


SCENARIOS = {
    "equilibre": {"economique": 0.35, "eau": 0.35, "topographie": 0.30},
    "eau": {"economique": 0.2, "eau": 0.6, "topographie": 0.2},
    "topographie": {"economique": 0.25, "eau": 0.25, "topographie": 0.5},
}
_VALUES = ", ".join(f"('{n}', {w['economique']}::DOUBLE, {w['eau']}::DOUBLE, {w['topographie']}::DOUBLE)" for n, w in SCENARIOS.items())


@query(with_tables("parcels") + f""", {AXES_SQL}, scenarios(scenario, we, wa, wt) AS (VALUES {_VALUES}),
  s AS (SELECT id, scenario, {global_sql({'economique': 'we', 'eau': 'wa', 'topographie': 'wt'})} AS score_global FROM axes, scenarios)
  SELECT *, {rank_sql('PARTITION BY scenario')} AS rang FROM s""")
def scenario_ranks(spark, sf):
    scored = scoring.score_scenarios(standin(spark, sf, "parcels"), SCENARIOS)
    return scoring.rank_scores(scored.select("id", "scenario", "score_global"), ["scenario"])


@query(with_tables("parcels") + f""", {AXES_SQL}, scenarios AS (SELECT r_name AS scenario, (r_regionkey + 1) / 10.0::DOUBLE AS we, 0.3::DOUBLE AS wa,
    1.0::DOUBLE - (r_regionkey + 1) / 10.0::DOUBLE - 0.3::DOUBLE AS wt FROM region)
  SELECT id, scenario, {global_sql({'economique': 'we', 'eau': 'wa', 'topographie': 'wt'})} AS score_global FROM axes, scenarios""")
def scenario_table_scores(spark, sf):
    first = (F.col("r_regionkey") + 1) / F.lit(10.0)
    scenarios = table(spark, sf, "region").select(
        F.col("r_name").alias("scenario"), first.alias("poids_economique"), F.lit(0.3).alias("poids_eau"),
        (F.lit(1.0) - first - F.lit(0.3)).alias("poids_topographie"))
    return scoring.score_scenarios(standin(spark, sf, "parcels"), scenarios).select("id", "scenario", "score_global")


_MANY = """scenarios AS (SELECT CAST(c_custkey AS STRING) AS scenario, (c_custkey % 50) / 100.0::DOUBLE AS we, 0.3::DOUBLE AS wa,
    1.0::DOUBLE - (c_custkey % 50) / 100.0::DOUBLE - 0.3::DOUBLE AS wt FROM customer)"""


@query(with_tables("parcels") + f""", {AXES_SQL}, {_MANY}, s AS (SELECT id, scenario, {global_sql({'economique': 'we', 'eau': 'wa', 'topographie': 'wt'})} AS score
    FROM axes, scenarios)
  SELECT id, count(*) AS n_scenarios, CAST(sum(score) AS BIGINT) AS total, min(score) AS lowest, max(score) AS highest FROM s GROUP BY id""")
def parcels_under_all_customers_weights(spark, sf):
    """A scenario per customer: well over a thousand of them, for every parcel."""
    first = (F.col("c_custkey") % 50) / F.lit(100.0)
    customers = table(spark, sf, "customer")
    scenarios = customers.select(
        F.col("c_custkey").cast("string").alias("scenario"), first.alias("poids_economique"), F.lit(0.3).alias("poids_eau"),
        (F.lit(1.0) - first - F.lit(0.3)).alias("poids_topographie"))
    each = scoring.scenario_totals(standin(spark, sf, "parcels"), scenarios)
    return each.groupBy("id").agg(F.sum("n_scenarios").alias("n_scenarios"), F.sum("total").alias("total"),
                                  F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


@query(SCORED + f" SELECT id, score_global, {rank_sql()} AS rang FROM scored")
def parcel_ranks(spark, sf):
    return scoring.rank_scores(_scored(spark, sf).select("id", "score_global"))


@query(SCORED + """ SELECT nom AS "Parcelle", id AS "ID", score_global AS "Score global", score_economique AS "Éco (35%)", score_eau AS "Eau (35%)",
  score_topographie AS "Topo (30%)" FROM scored""")
def summary_table(spark, sf):
    return scoring.summary_table(_scored(spark, sf))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_LONG = "long AS ({} UNION ALL {} UNION ALL {})".format(*(
    f"SELECT id, nom, commune, '{label}' AS axe, score_{axis} AS score FROM scored" for axis, label in scoring.AXIS_LABELS.items()))


@query(SCORED + f", {_LONG} SELECT axe AS \"Axe\", " + ", ".join(f"max(score) FILTER (WHERE commune = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM long GROUP BY axe")
def axis_table_by_town(spark, sf):
    return scoring.axis_table(_scored(spark, sf).withColumn("nom", F.col("commune")), SEGMENTS)


@query(SCORED + " " + " UNION ALL ".join(
    f"SELECT id, '{scoring.AXIS_LABELS[a]}' AS axe, '{c.replace('_', ' ').title()}' AS critere, critere_{c} AS score, "
    f"CASE WHEN critere_{c} >= 70 THEN 'Favorable' WHEN critere_{c} >= 45 THEN 'Mitigé' ELSE 'Défavorable' END AS mention FROM scored"
    for a, m in scoring.AXIS_CRITERIA.items() for c in m))
def criteria_rows(spark, sf):
    return scoring.criteria_rows(_scored(spark, sf)).drop("nom")


@query(SCORED + f", {_LONG} SELECT axe, id, nom, score FROM long QUALIFY row_number() OVER (PARTITION BY axe ORDER BY score DESC, id) = 1")
def best_parcel_per_axis(spark, sf):
    return scoring.best_per_axis(_scored(spark, sf))


@query(SCORED + """ SELECT id, CASE WHEN score_global >= 70 THEN 'Favorable' WHEN score_global >= 45 THEN 'Mitigé' ELSE 'Défavorable' END AS mention,
  score_global >= 70 AS recommandee FROM scored""")
def verdicts(spark, sf):
    return scoring.with_verdict(_scored(spark, sf)).select("id", "mention", "recommandee")


@query(SCORED + " SELECT id, score_global FROM scored WHERE id IN (SELECT CAST(o_custkey AS STRING) FROM orders WHERE o_totalprice > 490000)")
def scores_of_chosen_parcels(spark, sf):
    chosen = table(spark, sf, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").cast("string").alias("id"))
    return scoring.choose(_scored(spark, sf).select("id", "score_global"), chosen)


@query(SCORED + """ SELECT id, commune, score_economique AS economique, critere_acces_eau AS acces_eau, critere_altitude AS altitude, acces_eau AS source_eau,
  pente_pct FROM scored""")
def report_rows(spark, sf):
    return scoring.report_rows(_scored(spark, sf)).select(
        "id", "identite.commune", F.col("axes")[0]["score"].alias("economique"), F.col("axes")[1]["criteres"]["acces_eau"].alias("acces_eau"),
        F.col("axes")[2]["criteres"]["altitude"].alias("altitude"), F.col("caracteristiques.eau.acces_eau").alias("source_eau"),
        F.col("caracteristiques.topographie.pente_pct").alias("pente_pct"))


@query("""SELECT CAST(c_custkey AS STRING) AS id, concat_ws('; ', CASE WHEN c_custkey % 6 = 5 THEN 'nom: required' END,
    CASE WHEN CAST(c_custkey % 4 AS DOUBLE) - 1 < 0.1 THEN 'surface_ha: outside 0.1..' END, CASE WHEN c_acctbal < 1000 THEN 'prix_achat: outside 0.0..' END,
    CASE WHEN c_custkey % 130 > 100 THEN 'pente_pct: outside 0.0..100.0' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'acces_eau: not one of forage/riviere/reseau/aucun/inconnu' END) AS errors FROM customer""")
def parcel_errors(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 6 != 5, F.col("c_name")).alias("nom"),
        ((F.col("c_custkey") % 4).cast("double") - 1).alias("surface_ha"), F.lit("x").alias("commune"), F.lit("72").alias("departement"),
        F.lit(47.0).alias("lat"), F.lit(0.0).alias("lon"), (F.col("c_acctbal") - 1000).alias("prix_achat"),
        (F.col("c_custkey") % 130).cast("double").alias("pente_pct"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.col("c_mktsegment")).alias("acces_eau"))
    return validate.check_parcels(raw).select("id", F.array_join("errors", "; ").alias("errors"))
