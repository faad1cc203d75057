"""Market-gap analysis: who produces what where, and which zones lack supply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.operators.conform import concat
from glebe.operators.enrichment import count_within
from glebe.operators.tree import build
from glebe.operators.quantiles import group_quantiles
from glebe.operators.spatial import nearest, points_in_zones

# Activities that count as restaurants.
RESTAURANT_ACTIVITIES = ["56.10A", "56.10B"]


def consolidate(sources: dict[str, DataFrame], renames: dict[str, str] | None = None,
                key: tuple[str, ...] = ("nom", "commune")) -> DataFrame:
    """Producer lists under common names, tagged with ``source``, one row per key.

    The row of the first source (in the given order) wins; within one source the smallest row.
    """
    renames = renames or {"Nom": "nom", "Adresse": "adresse", "Commune": "commune", "Code Postal": "cp"}
    tagged = [
        df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})
        .withColumns({"source": F.lit(name), "_rank": F.lit(i)})
        for i, (name, df) in enumerate(sources.items())
    ]
    both = concat(tagged, relaxed=True)
    rest = [c for c in both.columns if c not in (*key, "_rank")]
    first = F.min(F.struct("_rank", *rest)).alias("_row")
    return both.groupBy(*key).agg(first).select(*key, *(F.col("_row")[c].alias(c) for c in rest))


def products_of(producers: DataFrame, column: str = "type_produit") -> DataFrame:
    """One row per producer and product of a list separated by "|"."""
    return producers.withColumn(column, F.explode_outer(F.split(column, r"\|"))).withColumn(column, F.trim(column))


def product_matrix(producers: DataFrame, column: str = "type_produit", towns: int = 5) -> DataFrame:
    """Per product: distinct producer names and its first towns in order; rarest product first."""
    listed = products_of(producers, column).filter(F.col(column).isNotNull())
    # Towns are made distinct by their own shuffle, so no product gathers its whole producer list.
    pairs = listed.select(column, "commune").distinct().filter(F.col("commune").isNotNull())
    ranks = _first_n(pairs, [column], "commune", towns)
    names = listed.groupBy(column).agg(F.countDistinct("nom").alias("nb_producteurs"))
    zones = ranks.groupBy(column).agg(F.array_join(F.sort_array(F.collect_list("commune")), ", ").alias("zones"))
    return names.join(zones, column, "left").orderBy("nb_producteurs", column)


def _first_n(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n smallest values per key, found within hash slices first so that a large key is shared out."""
    slices = df.withColumn("_slice", F.pmod(F.xxhash64(value), F.lit(64)))
    local = Window.partitionBy(*keys, "_slice").orderBy(value)
    short = slices.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
    overall = Window.partitionBy(*keys).orderBy(value)
    return short.withColumn("_r", F.row_number().over(overall)).filter(F.col("_r") <= n).drop("_r", "_slice")


def active_businesses(registry: DataFrame, postcode_prefix: str, activities: list[str] | None = None) -> DataFrame:
    """Active establishments of some activities whose postcode starts with a prefix."""
    return registry.filter(
        F.col("code_postal").startswith(postcode_prefix)
        & F.col("activite").isin(*(activities or RESTAURANT_ACTIVITIES))
        & (F.col("etat") == "A")
    )


def count_in_zones(located: DataFrame, zones: DataFrame, zone: str, products: list[str],
                   product: str = "type_produit") -> DataFrame:
    """Zones with ``nb_<product>`` for each wanted product; zones without any get 0.

    ``located`` has one row per producer with the zone it lies in; the product text may list several.
    """
    counts = located.filter(F.col(zone).isNotNull()).groupBy(zone).agg(
        *(F.count_if(F.col(product).contains(p)).alias(f"nb_{p}") for p in products))
    return zones.join(counts, zone, "left").fillna(0, [f"nb_{p}" for p in products])


def with_income(zones: DataFrame, income: DataFrame, town: str, income_town: str, value: str) -> DataFrame:
    """Left join of a town income table."""
    lookup = income.select(F.col(income_town).alias("_town"), F.col(value).alias(value))
    return zones.join(lookup, F.col(town) == F.col("_town"), "left").drop("_town")


def opportunity(zones: DataFrame, restaurants: str, income: str, producers: str, out: str = "score") -> DataFrame:
    """max(0, 2 x restaurants + 5 x income / highest income - 10 x producers)."""
    top = zones.select(F.max(income)).scalar()
    share = F.coalesce(F.try_divide(F.coalesce(income, F.lit(0.0)), top), F.lit(0.0))
    value = F.col(restaurants) * 2 + share * 5 - F.col(producers) * 10
    return zones.withColumn(out, F.greatest(F.lit(0.0), value.cast("double")))


def scale_to_ten(df: DataFrame, column: str, out: str) -> DataFrame:
    """Min-max scale to 0..10; null when all values are equal."""
    ends = df.select(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    scaled = F.try_divide(F.col(column) - F.col("_ends.low"), F.col("_ends.high") - F.col("_ends.low")) * 10
    return df.withColumn("_ends", ends).withColumn(out, scaled).drop("_ends")


def top_share(df: DataFrame, score: str, key: str, share: float = 0.2, n: int | None = 10) -> DataFrame:
    """Rows at or above the (1 - share) quantile (interpolated), best first, at most n."""
    threshold = group_quantiles(df, [], score, {"seuil": 1 - share}, "linear").select("seuil").scalar()
    best = df.withColumn("_seuil", threshold).filter(F.col(score) >= F.col("_seuil")).drop("_seuil")
    best = best.orderBy(F.col(score).desc_nulls_last(), key)
    return best if n is None else best.limit(n)


def uncovered(cells: DataFrame, producers: DataFrame, radius_km: float, zone: str, population: str, cell: str) -> DataFrame:
    """Per zone: population of the cells without a producer in range, and the number of such cells.

    Only the nearest producer of a cell matters, so no cell is paired with all producers around it.
    """
    spots = producers.select("latitude", "longitude").distinct()
    reached = nearest(cells.select(cell, "lat", "lon"), spots, 1).filter(F.col("distance") <= radius_km).select(cell)
    missed = cells.join(reached, cell, "left_anti")
    return missed.groupBy(zone).agg(F.sum(population).alias("pop_non_couverte"), F.count(F.lit(1)).alias("n_cellules"))


def density(cells: DataFrame, producers: DataFrame, radius_km: float = 15.0) -> DataFrame:
    """Producers within the radius of each cell centre (0 without one)."""
    spots = producers.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("copies"))
    counts = count_within(cells.select("lat", "lon"), build(spots, weight="copies"), radius_km, "copies")
    return cells.join(counts, ["lat", "lon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def producers_in_zones(producers: DataFrame, zones: DataFrame, shape: str, lat: str, lon: str, **grid) -> DataFrame:
    """Producers with the zone that holds them; null outside every zone."""
    return points_in_zones(producers, zones, shape, lat, lon, **grid)


def water_balance(weather: DataFrame, every: str = "month", keys: list[str] | None = None) -> DataFrame:
    """Rain, ETP and rain minus ETP per point and period (1 decimal)."""
    if every not in ("week", "month", "year"):
        raise ValueError(f"period must be 'week', 'month' or 'year', not {every!r}")
    keys = keys or ["latitude", "longitude"]
    rain, etp = F.sum("precipitation_sum"), F.sum("et0_fao_evapotranspiration")
    return weather.groupBy(*keys, F.trunc("date", every).alias("periode")).agg(
        rounded(rain, 1).alias("pluie_mm"), rounded(etp, 1).alias("etp_mm"), rounded(rain - etp, 1).alias("bilan_mm"))
