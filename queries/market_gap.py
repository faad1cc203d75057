"""Market-gap analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.operators import market_gap
from queries.registry import query
from queries.spatial import PAIR_KM
from queries.standins import standin, table, with_tables

PRODUCTS = ["oeufs", "miel", "champignons"]
PRODUCERS = with_tables("producers")


@query("""SELECT nom, commune, source, CAST(cp AS STRING) AS cp FROM (SELECT s_name AS nom, CAST(s_nationkey AS STRING) AS commune, 'a.csv' AS source, s_suppkey AS cp, 0 AS r FROM supplier
  UNION ALL SELECT concat('Supplier#', lpad(CAST(c_custkey % 200 AS STRING), 9, '0')), CAST(c_nationkey AS STRING), 'b.csv', c_custkey, 1 FROM customer)
  QUALIFY row_number() OVER (PARTITION BY nom, commune ORDER BY r, cp) = 1""")
def consolidated_producers(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_name").alias("Nom"), F.col("s_nationkey").cast("string").alias("Commune"), F.col("s_suppkey").alias("Code Postal"))
    b = table(spark, sf, "customer").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0")).alias("nom"),
                                            F.col("c_nationkey").cast("string").alias("commune"), F.col("c_custkey").alias("cp"))
    return market_gap.consolidate({"a.csv": a, "b.csv": b}).select("nom", "commune", "source", F.col("cp").cast("string").alias("cp"))


LISTED = PRODUCERS + ", listed AS (SELECT nom, commune, trim(unnest(string_split(type_produit, '|'))) AS type_produit FROM producers)"


@query(LISTED + " SELECT nom, type_produit FROM listed")
def producer_products(spark, sf):
    return market_gap.products_of(standin(spark, sf, "producers")).select("nom", "type_produit")


@query(LISTED + """, towns AS (SELECT DISTINCT type_produit, commune FROM listed), five AS (SELECT * FROM towns QUALIFY row_number() OVER (PARTITION BY type_produit ORDER BY commune) <= 5)
  SELECT type_produit, nb_producteurs, zones FROM (SELECT type_produit, count(DISTINCT nom) AS nb_producteurs FROM listed GROUP BY 1)
  JOIN (SELECT type_produit, string_agg(commune, ', ' ORDER BY commune) AS zones FROM five GROUP BY 1) USING (type_produit)""")
def product_matrix(spark, sf):
    return market_gap.product_matrix(standin(spark, sf, "producers"))


@query("""SELECT o_orderkey FROM orders WHERE lpad(CAST(o_custkey AS STRING), 5, '0') LIKE '000%' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'""")
def active_businesses(spark, sf):
    registry = table(spark, sf, "orders").select(
        "o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("code_postal"), F.col("o_orderpriority").alias("activite"),
        F.when(F.col("o_orderstatus") == "O", "A").otherwise("F").alias("etat"))
    return market_gap.active_businesses(registry, "000", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


ZONES = PRODUCERS + """, zones AS (SELECT n_name AS commune, n_nationkey, n_nationkey % 8 AS nb_restaurants, CASE WHEN n_nationkey % 6 <> 0 THEN 15000.0::DOUBLE + n_nationkey * 371 END AS revenu FROM nation),
  counts AS (SELECT commune, """ + ", ".join(f"count(*) FILTER (WHERE contains(type_produit, '{p}')) AS nb_{p}" for p in PRODUCTS) + """ FROM producers GROUP BY 1),
  counted AS (SELECT commune, n_nationkey, nb_restaurants, revenu, """ + ", ".join(f"coalesce(nb_{p}, 0) AS nb_{p}" for p in PRODUCTS) + """ FROM zones LEFT JOIN counts USING (commune)),
  scored AS (SELECT *, greatest(0.0::DOUBLE, nb_restaurants * 2 + coalesce(revenu, 0) / (SELECT max(revenu) FROM counted) * 5 - nb_champignons * 10) AS score FROM counted)"""


def _counted(spark, sf):
    zones = table(spark, sf, "nation").select(F.col("n_name").alias("commune"), "n_nationkey", (F.col("n_nationkey") % 8).alias("nb_restaurants"))
    # Some zones have no income: their rows carry no code.
    income = table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")).alias("code"), (F.lit(15000.0) + F.col("n_nationkey") * 371).alias("revenu"))
    counted = market_gap.count_in_zones(standin(spark, sf, "producers"), zones, "commune", PRODUCTS)
    return market_gap.with_income(counted, income, "commune", "code", "revenu")


@query(ZONES + " SELECT commune, nb_oeufs, nb_miel, nb_champignons, revenu FROM counted")
def producers_per_zone(spark, sf):
    return _counted(spark, sf).select("commune", "nb_oeufs", "nb_miel", "nb_champignons", "revenu")


def _scored(spark, sf):
    return market_gap.opportunity(_counted(spark, sf), "nb_restaurants", "revenu", "nb_champignons")


@query(ZONES + """ SELECT commune, round(score, 6) AS score, round((score - (SELECT min(score) FROM scored)) / ((SELECT max(score) FROM scored) - (SELECT min(score) FROM scored)) * 10, 6) AS norme FROM scored""")
def opportunity_scores(spark, sf):
    scaled = market_gap.scale_to_ten(_scored(spark, sf), "score", "norme")
    return scaled.select("commune", rounded("score", 6).alias("score"), rounded("norme", 6).alias("norme"))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.8) FROM customer) ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def best_fifth(spark, sf):
    return market_gap.top_share(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.8) FROM customer)""")
def best_fifth_in_full(spark, sf):
    return market_gap.top_share(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", n=None)


CELLS = with_tables("bare_parcels", "producers") + ", cells AS (SELECT id, lat, lon, CAST(id AS BIGINT) % 9 AS zone, CAST(id AS BIGINT) % 100 AS pop FROM bare_parcels)"


def _cells(spark, sf):
    no = F.col("id").cast("bigint")
    return standin(spark, sf, "bare_parcels").withColumns({"zone": no % 9, "pop": no % 100})


@query(CELLS + f""" SELECT zone, CAST(sum(pop) AS BIGINT) AS pop_non_couverte, count(*) AS n_cellules FROM cells
  WHERE id NOT IN (SELECT id FROM cells, producers WHERE latitude BETWEEN lat - 0.5 AND lat + 0.5 AND {PAIR_KM} <= 40) GROUP BY zone""")
def uncovered_population(spark, sf):
    return market_gap.uncovered(_cells(spark, sf), standin(spark, sf, "producers"), 40, "zone", "pop", "id")


@query(CELLS + f" SELECT id, count(nom) AS n FROM cells LEFT JOIN producers ON latitude BETWEEN lat - 0.2 AND lat + 0.2 AND {PAIR_KM} <= 15 GROUP BY id")
def producer_density(spark, sf):
    return market_gap.density(_cells(spark, sf), standin(spark, sf, "producers")).select("id", "n")
