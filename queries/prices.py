"""Price-quote analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from glebe.operators import filters, prices
from glebe.operators.quantiles import group_quantiles
from glebe.plans import jobs
from queries.registry import ORACLES, query
from queries.standins import standin, table, with_tables

QUOTES = with_tables("quotes") + """, shown AS (SELECT *, TRY_CAST(try_strptime(date, '%d/%m/%Y') AS DATE) AS date_cot, split_part(produit, ' ', 1) AS famille
  FROM quotes WHERE prix_moyen IS NOT NULL)"""


def _shown(spark, sf):
    return prices.display_quotes(standin(spark, sf, "quotes"))


def _families(spark, sf):
    """Quotes with the family as product, for tables with one column per product."""
    return _shown(spark, sf).withColumn("produit", F.col("famille"))


@query(QUOTES + """ SELECT annee, date_cot, produit, marche, stade, unite, famille, prix_min, prix_moyen, prix_max FROM shown""")
def displayed_quotes(spark, sf):
    return _shown(spark, sf)


@query(QUOTES + """ SELECT produit, marche, count(*) AS n FROM shown WHERE famille = 'ECONOMY' AND marche IN ('MARCHE 1', 'MARCHE 2') GROUP BY ALL""")
def selected_quotes(spark, sf):
    chosen = prices.select_quotes(_shown(spark, sf), markets=["MARCHE 1", "MARCHE 2"], family="ECONOMY")
    return chosen.groupBy("produit", "marche").agg(F.count("*").alias("n"))


@query(QUOTES + " SELECT DISTINCT produit FROM shown")
def product_choices(spark, sf):
    return prices.selector_values(_shown(spark, sf), "produit")


METRICS = "count(*) AS n_cotations, min(date_cot) AS premiere_date, max(date_cot) AS derniere_date, round(avg(prix_moyen), 2) AS prix_moyen FROM shown"


@query(QUOTES + f" SELECT {METRICS}")
def quote_metrics(spark, sf):
    return prices.selection_metrics(_shown(spark, sf))


@query(QUOTES + f" SELECT famille, {METRICS} GROUP BY famille")
def quote_metrics_by_family(spark, sf):
    return prices.selection_metrics(_shown(spark, sf), ["famille"])


def _trend_sql(by: str) -> str:
    group = f"PARTITION BY {by}" if by else ""
    return QUOTES + f""", ranked AS (SELECT *, row_number() OVER ({group} ORDER BY date_cot NULLS LAST, prix_moyen) AS r, count(*) OVER ({group}) AS n FROM shown),
      ends AS (SELECT {by + ', ' if by else ''}avg(prix_moyen) FILTER (WHERE r <= greatest(1, n // 10)) AS a, avg(prix_moyen) FILTER (WHERE r > n - greatest(1, n // 10)) AS b
        FROM ranked {'GROUP BY ' + by if by else ''})
      SELECT {by + ', ' if by else ''}round(a, 3) AS prix_debut, round(b, 3) AS prix_fin, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END, 1) AS variation_pct FROM ends"""


@query(_trend_sql("produit"))
def price_trend_by_product(spark, sf):
    return prices.price_trend(_shown(spark, sf), ["produit"])


@query(_trend_sql(""))
def price_trend_overall(spark, sf):
    return prices.price_trend(_shown(spark, sf).withColumn("_all", F.lit(0)), ["_all"]).drop("_all")


def _series_sql(every: str) -> str:
    return QUOTES + f" SELECT produit, CAST(date_trunc('{every}', date_cot) AS DATE) AS periode, round(avg(prix_moyen), 3) AS prix_moy FROM shown GROUP BY ALL"


@query(_series_sql("week"))
def weekly_prices(spark, sf):
    return prices.price_series(_shown(spark, sf), "week")


@query(_series_sql("month"))
def monthly_prices(spark, sf):
    return prices.price_series(_shown(spark, sf), "month")


FAMILIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(QUOTES + " SELECT CAST(date_trunc('week', date_cot) AS DATE) AS periode, "
       + ", ".join(f"round(avg(prix_moyen) FILTER (WHERE famille = '{f}'), 3) AS \"{f}\"" for f in FAMILIES) + " FROM shown GROUP BY ALL")
def weekly_prices_wide(spark, sf):
    return prices.price_series_wide(_families(spark, sf), FAMILIES, "week")


def _distribution_sql(quantile: str) -> str:
    return QUOTES + f""" SELECT produit, count(*) AS n_cotations, round(min(prix_moyen), 3) AS prix_min, round({quantile}(prix_moyen, 0.25), 3) AS p25,
      round(median(prix_moyen), 3) AS mediane, round(avg(prix_moyen), 3) AS prix_moyen, round({quantile}(prix_moyen, 0.75), 3) AS p75,
      round(max(prix_moyen), 3) AS prix_max, first(unite ORDER BY date_cot NULLS LAST, unite) AS unite FROM shown GROUP BY produit"""


@query(_distribution_sql("quantile_disc"))
def price_distribution(spark, sf):
    return prices.price_distribution(_shown(spark, sf))


@query(_distribution_sql("quantile_cont"))
def price_distribution_interpolated(spark, sf):
    return prices.price_distribution(_shown(spark, sf), "linear")


@query("""SELECT l_returnflag AS g, count(l_extendedprice) AS n, quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.5) AS p50,
  quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def price_quantiles_of_large_groups(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_extendedprice")
    return group_quantiles(lines, ["g"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


MONTHS = ["Jan", "Fév", "Mar", "Avr", "Mai", "Jun", "Jul", "Aoû", "Sep", "Oct", "Nov", "Déc"]
_LABEL = "CASE month(date_cot) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS, 1)) + " END"


@query(QUOTES + f" SELECT produit, CAST(month(date_cot) AS INT) AS mois, round(avg(prix_moyen), 3) AS prix_moy, {_LABEL} AS mois_label FROM shown GROUP BY ALL")
def seasonality(spark, sf):
    return prices.seasonality(_shown(spark, sf))


@query(QUOTES + " SELECT produit, " + ", ".join(f"round(avg(prix_moyen) FILTER (WHERE month(date_cot) = {i}), 3) AS \"{m}\"" for i, m in enumerate(MONTHS, 1))
       + " FROM shown GROUP BY produit")
def seasonality_wide(spark, sf):
    return prices.seasonality_wide(_shown(spark, sf))


@query(QUOTES + """ SELECT date_cot AS "Date", produit AS "Produit", left(marche, 35) AS "Marché", round(prix_moyen, 3) AS "Prix moy. (€)", unite AS "Unité" FROM shown
  ORDER BY date_cot DESC NULLS LAST, produit, marche, prix_moyen, unite LIMIT 200""")
def latest_quotes(spark, sf):
    return prices.latest_quotes(_shown(spark, sf))


@query(QUOTES + f" SELECT {METRICS} WHERE famille IN ('ECONOMY', 'PROMO')")
def dashboard_metrics(spark, sf):
    families = standin(spark, sf, "quotes").withColumn("produit", F.substring_index("produit", " ", 1))
    return jobs.price_dashboard(families, ["ECONOMY", "PROMO"])["metrics"]


def _picked(sql: str) -> str:
    """The same over the two families of the dashboard, each as one product."""
    picked = ", picked AS (SELECT * REPLACE (famille AS produit) FROM shown WHERE famille IN ('ECONOMY', 'PROMO'))"
    return QUOTES + picked + sql.removeprefix(QUOTES).replace("FROM shown", "FROM picked")


def _dashboard(spark, sf, name):
    families = standin(spark, sf, "quotes").withColumn("produit", F.substring_index("produit", " ", 1))
    return jobs.price_dashboard(families, ["ECONOMY", "PROMO"])[name]


@query(_picked(_trend_sql("")))
def dashboard_trend(spark, sf):
    return _dashboard(spark, sf, "trend")


@query(_picked(" SELECT CAST(date_trunc('week', date_cot) AS DATE) AS periode, "
       + ", ".join(f"round(avg(prix_moyen) FILTER (WHERE produit = '{f}'), 3) AS \"{f}\"" for f in ("ECONOMY", "PROMO")) + " FROM shown GROUP BY ALL"))
def dashboard_series(spark, sf):
    return _dashboard(spark, sf, "series")


@query(_picked(_distribution_sql("quantile_disc")))
def dashboard_distribution(spark, sf):
    return _dashboard(spark, sf, "distribution")


@query(_picked(ORACLES["seasonality_wide"]))
def dashboard_seasonality(spark, sf):
    return _dashboard(spark, sf, "seasonality")


@query(_picked(ORACLES["latest_quotes"]))
def dashboard_latest(spark, sf):
    return _dashboard(spark, sf, "latest")


@query(with_tables("quotes") + " SELECT marche, stade, count(*) AS n FROM quotes WHERE upper(trim(marche)) IN ('MARCHE 3', 'MARCHE 7') AND stade IN ('A', 'N') GROUP BY ALL")
def quotes_of_markets(spark, sf):
    kept = filters.quotes_of(standin(spark, sf, "quotes"), [" marche 3", "Marche 7 "], ["a", "N"])
    return kept.groupBy("marche", "stade").agg(F.count("*").alias("n"))


@query(with_tables("quotes") + """ SELECT marche, count(*) AS n FROM quotes WHERE marche IN (SELECT concat('MARCHE ', CAST(s_suppkey AS STRING)) FROM supplier WHERE s_acctbal > 5000)
  GROUP BY ALL""")
def quotes_of_listed_markets(spark, sf):
    listed = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("Marche "), F.col("s_suppkey").cast("string")).alias("m"))
    return filters.quotes_of(standin(spark, sf, "quotes"), listed).groupBy("marche").agg(F.count("*").alias("n"))
