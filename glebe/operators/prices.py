"""Price-quote analytics: selections, trend, series, distribution, seasonality, latest quotes.

Input is the ``price_quotes`` table, or ``display_quotes`` of it, with ``date_cot``, ``produit``,
``marche``, ``unite``, ``famille`` and the price columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glebe.functions.dates import period_start, slash_date
from glebe.functions.numbers import rounded
from glebe.functions.text import first_word, map_label, short_label
from glebe.operators.quantiles import quantiles_of_counts, value_counts
from glebe.schemas import MONTH_LABELS


def display_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with a mean price, the parsed date and the product family. Bad dates become null."""
    return quotes.filter(F.col("prix_moyen").isNotNull()).select(
        "annee", slash_date(F.col("date")).alias("date_cot"), "produit", "marche", "stade", "unite",
        "prix_min", "prix_moyen", "prix_max", first_word(F.col("produit")).alias("famille"),
    )


def select_quotes(quotes: DataFrame, products: list[str] | None = None, markets: list[str] | None = None,
                  family: str | None = None) -> DataFrame:
    """Quotes with a mean price for the chosen products, markets and family; None keeps all."""
    kept = quotes.filter(F.col("prix_moyen").isNotNull())
    if family is not None:
        kept = kept.filter(F.col("famille") == family)
    if products is not None:
        kept = kept.filter(F.col("produit").isin(*products))
    if markets is not None:
        kept = kept.filter(F.col("marche").isin(*markets))
    return kept


def selector_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in order, for a choice list."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def selection_metrics(quotes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of quotes, date span and mean price of a selection."""
    return quotes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_cotations"),
        F.min("date_cot").alias("premiere_date"),
        F.max("date_cot").alias("derniere_date"),
        rounded(F.avg("prix_moyen"), 2).alias("prix_moyen"),
    )


def price_trend(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Per group: mean price of the first and of the last tenth of the quotes by date, and the change.

    The tenth has n div 10 quotes, at least one. Quotes without a date come last; quotes of one day are
    taken in order of price. The change is 0 when the first mean is 0 or missing. Days are summed first;
    only the day in which the tenth ends is looked at price by price.
    """
    priced = quotes.groupBy(*by, "date_cot", "prix_moyen").agg(F.count(F.lit(1)).alias("_n"))
    day = [*by, "date_cot"]
    daily = priced.groupBy(*day).agg(F.sum("_n").alias("_n"),
                                     F.sum(F.col("prix_moyen") * F.col("_n")).alias("_sum"))
    group = Window.partitionBy(*by)
    days_before = group.orderBy(F.col("date_cot").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    daily = (
        daily.withColumn("_before", F.coalesce(F.sum("_n").over(days_before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(group))
        .withColumn("_tenth", F.greatest(F.lit(1), F.floor(F.col("_total") / 10)))
    )
    last_start = F.col("_total") - F.col("_tenth")
    day_end = F.col("_before") + F.col("_n")
    whole_first = day_end <= F.col("_tenth")
    whole_last = F.col("_before") >= last_start
    whole = daily.select(
        *by, "_tenth", F.when(whole_first, F.col("_sum")).alias("_first"), F.when(whole_last, F.col("_sum")).alias("_last"))

    # The days that are cut by the end of the first tenth or the start of the last one.
    cut = daily.filter(((F.col("_before") < F.col("_tenth")) & ~whole_first)
                       | ((day_end > last_start) & ~whole_last))
    cut = cut.select(*(F.col(c).alias(f"_cut_{c}") for c in day), "_before", "_tenth", "_total")
    same_day = [F.col(c).eqNullSafe(F.col(f"_cut_{c}")) for c in day]
    prices_before = Window.partitionBy(*day).orderBy("prix_moyen").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_n").over(prices_before), F.lit(0))
    pieces = priced.join(cut, same_day).withColumn("_start", start)

    def part(low: Column, high: Column) -> Column:
        inside = F.least(F.col("_start") + F.col("_n"), high) - F.greatest(F.col("_start"), low)
        return F.greatest(F.lit(0), inside) * F.col("prix_moyen")

    # A cut day is not whole for the side it is cut on; a day whole for the other side is counted there.
    in_first = F.when(F.col("_tenth") < F.col("_day_end"), part(F.lit(0), F.col("_tenth")))
    in_last = F.when(F.col("_before") < last_start, part(last_start, F.col("_total")))
    day_total = F.sum("_n").over(Window.partitionBy(*day))
    pieces = pieces.withColumn("_day_end", F.col("_before") + day_total).select(
        *by, "_tenth", in_first.alias("_first"), in_last.alias("_last"))
    ends = whole.unionByName(pieces).groupBy(*by).agg(
        (F.sum("_first") / F.first("_tenth")).alias("prix_debut"),
        (F.sum("_last") / F.first("_tenth")).alias("prix_fin"),
    )
    change = F.try_divide(F.col("prix_fin") - F.col("prix_debut"), F.col("prix_debut")) * 100
    return ends.select(
        *by, rounded("prix_debut", 3).alias("prix_debut"), rounded("prix_fin", 3).alias("prix_fin"),
        rounded(F.coalesce(change, F.lit(0.0)), 1).alias("variation_pct"),
    )


def price_series(quotes: DataFrame, every: str = "week") -> DataFrame:
    """Mean price per product and week (from Monday) or month, three decimals."""
    return (
        quotes.withColumn("periode", period_start(F.col("date_cot"), every))
        .groupBy("produit", "periode").agg(rounded(F.avg("prix_moyen"), 3).alias("prix_moy"))
    )


def price_series_wide(quotes: DataFrame, products: list[str], every: str = "week", max_len: int = 40) -> DataFrame:
    """One row per period, one column per chosen product (short label); missing means are null.

    Products whose short labels coincide share a column, as one mean over both.
    """
    labelled = (
        quotes.filter(F.col("produit").isin(*products))
        .withColumn("label", short_label(F.col("produit"), max_len))
        .withColumn("periode", period_start(F.col("date_cot"), every))
    )
    columns = list(dict.fromkeys(p if len(p) <= max_len else p[:max_len] + "…" for p in products))
    return labelled.groupBy("periode").pivot("label", columns).agg(rounded(F.avg("prix_moyen"), 3)).orderBy("periode")


def price_distribution(quotes: DataFrame, method: str = "disc") -> DataFrame:
    """Per product: count, min, quartiles, median, mean, max and the unit of the earliest quote.

    Quartiles by ``method``, the median always interpolated. Quotes are counted per product and price
    once; all price figures come from those counts.
    """
    counted = value_counts(quotes, ["produit"], "prix_moyen")
    n = F.sum("_n")
    stats = counted.groupBy("produit").agg(
        n.alias("n_cotations"), rounded(F.min("_v"), 3).alias("prix_min"), rounded(F.max("_v"), 3).alias("prix_max"),
        rounded(F.sum(F.col("_v") * F.col("_n")) / n, 3).alias("prix_moyen"))
    wanted = {"p25": (0.25, method), "mediane": (0.5, "linear"), "p75": (0.75, method)}
    ranks = quantiles_of_counts(counted, ["produit"], wanted).drop("n")
    undated = F.lit("9999-12-31").cast("date")
    units = (
        quotes.groupBy("produit", "unite").agg(F.min(F.coalesce("date_cot", undated)).alias("_day"))
        .groupBy("produit").agg(F.min(F.struct("_day", "unite"))["unite"].alias("unite"))
    )
    return stats.join(ranks, "produit").join(units, "produit").select(
        short_label(F.col("produit"), 50).alias("produit"), "n_cotations", "prix_min",
        rounded("p25", 3).alias("p25"), rounded("mediane", 3).alias("mediane"), "prix_moyen",
        rounded("p75", 3).alias("p75"), "prix_max", "unite",
    )


def seasonality(quotes: DataFrame) -> DataFrame:
    """Mean price per product and calendar month, with the month label."""
    return (
        quotes.withColumn("mois", F.month("date_cot"))
        .groupBy("produit", "mois").agg(rounded(F.avg("prix_moyen"), 3).alias("prix_moy"))
        .withColumn("mois_label", month_label(F.col("mois")))
    )


def month_label(month: Column) -> Column:
    """Short French month name; other numbers are shown as they are."""
    return F.coalesce(map_label(month, MONTH_LABELS, None), month.cast("string"))


def seasonality_wide(quotes: DataFrame) -> DataFrame:
    """One row per product, one column per calendar month; months without quotes are null."""
    wide = (
        quotes.withColumn("mois", F.month("date_cot")).groupBy("produit")
        .pivot("mois", list(MONTH_LABELS)).agg(rounded(F.avg("prix_moyen"), 3))
    )
    months = [F.col(f"`{number}`").alias(label) for number, label in MONTH_LABELS.items()]
    return wide.select(short_label(F.col("produit"), 50).alias("produit"), *months)


def latest_quotes(quotes: DataFrame, n: int = 200) -> DataFrame:
    """The n newest quotes under display names; quotes without a date last, ties by product and market."""
    return (
        quotes.orderBy(F.col("date_cot").desc_nulls_last(), "produit", "marche", "prix_moyen", "unite").limit(n)
        .select(
            F.col("date_cot").alias("Date"),
            short_label(F.col("produit"), 55).alias("Produit"),
            F.substring("marche", 1, 35).alias("Marché"),
            rounded("prix_moyen", 3).alias("Prix moy. (€)"),
            F.col("unite").alias("Unité"),
        )
    )
