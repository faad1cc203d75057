"""Context of candidate parcels: climate normals, comparable price, wells nearby.

Parcels carry ``id``, ``lat``, ``lon``. Work is done once per distinct place and joined back, so parcels
that share a coordinate cost one search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.operators.quantiles import pick_quantiles, value_counts, wanted_slices
from glebe.operators.spatial import nearest, nearest_in, radius_parts
from glebe.operators.tree import Tree, build

# Narrow value slices in one of a block, as a power of two.
_BLOCK_SLICE_BITS = 2
SALE_RADIUS_KM = 20.0
WELL_RADIUS_KM = 5.0

# Warnings of the diagnostics.
NO_WEATHER_TABLE = "Meteo non enrichie: aucun parquet meteo disponible."
NO_WEATHER = "Meteo non enrichie: donnees locales introuvables."
NO_SALES_TABLE = "DVF non enrichi: aucun parquet prix_dvf disponible."
NO_LAND_AREA = "DVF non enrichi: colonne surface_terrain absente, €/ha indisponible."
NO_SALE = "DVF non enrichi: aucune transaction exploitable dans le rayon local."
NO_WELLS_TABLE = "BSS non enrichi: aucun parquet BSS disponible."


def usable_sales(sales: DataFrame) -> DataFrame:
    """Sales with coordinates, price and a positive land area."""
    return sales.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & F.col("valeur_fonciere").isNotNull() & (F.col("surface_terrain") > 0)
    )


def price_per_ha() -> Column:
    return F.col("valeur_fonciere") / (F.col("surface_terrain") / F.lit(10000.0))


def climate_normals(weather: DataFrame, keys: list[str] | None = None, min_days_per_year: int = 0) -> DataFrame:
    """Per point: mean of the yearly rain and ETP sums (1 decimal) and of the frost-day counts (whole days).

    A frost day has a minimum below 0. Incomplete years count unless ``min_days_per_year`` excludes them.
    """
    keys = keys or ["latitude", "longitude"]
    yearly = (
        weather.groupBy(*keys, F.year("date").alias("_year"))
        .agg(
            F.sum("precipitation_sum").alias("_rain"),
            F.sum("et0_fao_evapotranspiration").alias("_etp"),
            F.count_if(F.col("temperature_2m_min") < 0).alias("_frost"),
            F.count(F.lit(1)).alias("_days"),
        )
        .filter(F.col("_days") >= min_days_per_year)
    )
    return yearly.groupBy(*keys).agg(
        rounded(F.avg("_rain"), 1).alias("precip_mm"),
        rounded(F.avg("_frost"), 0).cast("int").alias("freeze_days"),
        rounded(F.avg("_etp"), 1).alias("etp_mm"),
        F.count(F.lit(1)).alias("n_years"),
    )


def weather_of_points(weather: DataFrame, points: DataFrame) -> DataFrame:
    """Weather rows of the listed (latitude, longitude) points only."""
    return weather.join(points.select("latitude", "longitude"), ["latitude", "longitude"], "left_semi")


def nearest_weather(parcels: DataFrame, weather: DataFrame, metric: str = "planar") -> DataFrame:
    """Climate normals of the weather point nearest to each parcel: id, ref_latitude, ref_longitude, normals."""
    return parcels.select("id", "lat", "lon").join(_weather_at(_places(parcels), weather, metric), ["lat", "lon"]).drop("lat", "lon")


def _places(parcels: DataFrame) -> DataFrame:
    return parcels.select("lat", "lon").distinct()


# What follows gives one row per place at most, so that it can be joined to parcels whose ids repeat.


def _weather_at(places: DataFrame, weather: DataFrame, metric: str) -> DataFrame:
    closest = nearest(places, weather.select("latitude", "longitude").distinct(), 1, metric)
    return (
        closest.select("lat", "lon", "latitude", "longitude")
        .join(climate_normals(weather), ["latitude", "longitude"])
        .withColumnsRenamed({"latitude": "ref_latitude", "longitude": "ref_longitude"})
    )


def _price_at(places: DataFrame, sales: DataFrame, radius_km: float) -> DataFrame:
    # Equal prices at one coordinate are counted before the join.
    spots = (
        usable_sales(sales).select("latitude", "longitude", price_per_ha().alias("prix_ha"))
        .groupBy("latitude", "longitude", "prix_ha").agg(F.count(F.lit(1)).alias("copies"))
    )
    medians = median_within(places, build(spots, weight="copies"), radius_km, "prix_ha", "copies")
    return medians.select("lat", "lon", rounded("prix_ha", 0).alias("prix_ha"), F.col("n").alias("n_sales"))


def _wells_at(places: DataFrame, wells: DataFrame, radius_km: float) -> DataFrame:
    tree = build(wells.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("copies")), weight="copies")
    counts = count_within(places, tree, radius_km, "copies").withColumnRenamed("n", "n_wells")
    # A node counts as a whole, so the nearest well is looked up by itself, in the same tree.
    closest = nearest_in(tree, places).filter(F.col("distance") <= radius_km)
    return closest.select("lat", "lon", F.col("distance").alias("nearest_km")).join(counts, ["lat", "lon"])


def median_within(places: DataFrame, tree: Tree, radius_km: float, value: str, weight: str) -> DataFrame:
    """Exact weighted median and count of a tree's spots within the radius of each place (lat, lon).

    Nodes of spots and single spots first add up to a histogram of value slices; values are only read from the slices
    that hold a place's median. A slice is some 1.6 % of the value wide, so a node costs a place some hundred rows at
    most, however many different values it has, and about one in a hundred of its values.
    """
    keys, wishes = ["lat", "lon"], {value: (0.5, "linear")}
    parts = radius_parts(places, tree, radius_km)
    block = list(parts.block_key)

    def counted(rows: DataFrame, by: list[str]) -> DataFrame:
        return value_counts(rows, by, value, weight).withColumn("_slice", F.shiftright("_slice", _BLOCK_SLICE_BITS))

    single, listed = counted(parts.pairs, keys), counted(parts.members, block)
    bars = listed.groupBy(*block, "_slice").agg(F.sum("_n").alias("_in"))
    histogram = (
        parts.blocks.join(bars, block).select(*keys, "_slice", "_in")
        .unionByName(single.select(*keys, "_slice", F.col("_n").alias("_in")))
        .groupBy(*keys, "_slice").agg(F.sum("_in").alias("_in"))
    )
    wanted = wanted_slices(histogram, keys, wishes)
    from_blocks = parts.blocks.drop("_n").join(wanted, keys).join(listed, [*block, "_slice"]).drop(*block)
    values = single.join(wanted, [*keys, "_slice"]).unionByName(from_blocks)
    values = values.groupBy(*wanted.columns, "_v").agg(F.sum("_n").alias("_n"))
    return pick_quantiles(values, keys, wishes)


def count_within(places: DataFrame, tree: Tree, radius_km: float, weight: str) -> DataFrame:
    """A tree's spots (``n``, by their weight) within the radius of each place (lat, lon)."""
    parts = radius_parts(places, tree, radius_km)
    hits = parts.pairs.select("lat", "lon", F.col(weight).alias("n")).unionByName(
        parts.blocks.select("lat", "lon", F.col("_n").alias("n")))
    return hits.groupBy("lat", "lon").agg(F.sum("n").alias("n"))


def comparable_price(parcels: DataFrame, sales: DataFrame, radius_km: float = SALE_RADIUS_KM) -> DataFrame:
    """Per parcel: median price per hectare of usable sales in the radius (whole euros) and their number.

    Without a sale: null and 0.
    """
    prices = _price_at(_places(parcels), sales, radius_km)
    return parcels.select("id", "lat", "lon").join(prices, ["lat", "lon"], "left").select(
        "id", "prix_ha", F.coalesce("n_sales", F.lit(0)).alias("n_sales"))


def wells_nearby(parcels: DataFrame, wells: DataFrame, radius_km: float = WELL_RADIUS_KM) -> DataFrame:
    """Per parcel: wells in the radius and km to the nearest of them (0 and null without one)."""
    around = _wells_at(_places(parcels), wells, radius_km)
    return parcels.select("id", "lat", "lon").join(around, ["lat", "lon"], "left").select(
        "id", F.coalesce("n_wells", F.lit(0)).alias("n_wells"), "nearest_km")


def _fill(old: str, new: Column, overwrite: bool) -> Column:
    current = F.col(old)
    return (F.coalesce(new, current) if overwrite else F.coalesce(current, new)).alias(old)


def enrich(parcels: DataFrame, weather: DataFrame | None, sales: DataFrame | None, wells: DataFrame | None,
           overwrite: bool = False, sale_radius_km: float = SALE_RADIUS_KM, well_radius_km: float = WELL_RADIUS_KM,
           weather_metric: str = "planar") -> DataFrame:
    """Parcels with the five context fields filled, plus ``diagnostics``.

    Only missing fields are filled unless ``overwrite``. A missing table (None) or a sales table without
    ``surface_terrain`` leaves its fields as they are and adds a warning. Point without any rain total:
    none of the weather fields is filled.
    """
    places = _places(parcels)
    joined = parcels
    found = {"precip_mm": "double", "freeze_days": "int", "etp_mm": "double", "n_years": "bigint", "ref_latitude": "double",
             "ref_longitude": "double", "prix_ha": "double", "n_sales": "bigint", "n_wells": "bigint", "nearest_km": "double"}
    no_price = sales is None or "surface_terrain" not in sales.columns
    tables = [] if weather is None else [_weather_at(places, weather, weather_metric).filter(F.col("precip_mm").isNotNull())]
    tables += [] if no_price else [_price_at(places, sales, sale_radius_km)]
    tables += [] if wells is None else [_wells_at(places, wells, well_radius_km)]
    for table in tables:
        joined = joined.join(table, ["lat", "lon"], "left")
    joined = joined.withColumns({n: F.lit(None).cast(t) for n, t in found.items() if n not in joined.columns})
    if wells is not None:
        joined = joined.withColumn("n_wells", F.coalesce("n_wells", F.lit(0)))

    weather_warning = F.lit(NO_WEATHER_TABLE) if weather is None else F.when(F.col("precip_mm").isNull(), NO_WEATHER)
    if sales is None:
        sale_warning = F.lit(NO_SALES_TABLE)
    elif no_price:
        sale_warning = F.lit(NO_LAND_AREA)
    else:
        sale_warning = F.when(F.col("prix_ha").isNull(), NO_SALE)
    well_warning = F.lit(NO_WELLS_TABLE if wells is None else None).cast("string")
    filled = {
        "meteo_precip_annuelle_mm": F.col("precip_mm"),
        "meteo_jours_gel": F.col("freeze_days"),
        "meteo_etp_annuelle_mm": F.col("etp_mm"),
        "prix_comparable_eur_ha": F.col("prix_ha"),
        "forages_brgm_count": F.col("n_wells").cast("int"),
    }
    diagnostics = F.struct(
        F.coalesce("n_years", F.lit(0)).cast("int").alias("weather_years"),
        F.col("ref_latitude").alias("weather_latitude"),
        F.col("ref_longitude").alias("weather_longitude"),
        F.coalesce("n_sales", F.lit(0)).cast("int").alias("dvf_transactions"),
        F.coalesce("n_wells", F.lit(0)).cast("int").alias("bss_stations"),
        F.col("nearest_km").alias("nearest_bss_km"),
        F.array_compact(F.array(weather_warning, sale_warning, well_warning)).alias("warnings"),
    )
    kept = [c for c in parcels.columns if c not in filled]
    have = set(parcels.columns)
    return joined.select(
        *kept,
        *(_fill(n, c, overwrite) if n in have else c.alias(n) for n, c in filled.items()),
        diagnostics.alias("diagnostics"),
    )
