"""Batch jobs: read what has landed, conform, filter, store, summarise.

Each job takes paths and parameters, writes its table and returns the summary its run reports.
"""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.functions.dates import since_date
from glebe.functions.numbers import rounded
from glebe.operators import conform, enrichment, filters, hours, latest, prices, scoring, spatial, summaries
from glebe.operators.conform import concat
from glebe.operators.validate import split_parcels
from glebe.schemas import GRID_MEASURES, GROUNDWATER, LAND_SALES, PRICE_QUOTES, WELLS
from glebe.sources import archives, landing, records, tables


def _flagged(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Fetch windows of the points that need one."""
    return plan.filter(~F.col("a_jour")).select(*keys, "debut", "fin")


def _inside_window(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of planned points inside their window."""
    windowed = rows.join(_flagged(plan, keys), keys)
    return windowed.filter(F.col("date").between(F.col("debut"), F.col("fin"))).drop("debut", "fin")


def _keep_rejects(rows: DataFrame, day: dt.date, path: str) -> None:
    tables.append_rows(rows.select(F.lit(day).alias("jour"), "raison", "contenu"), path)


def refresh_weather(spark: SparkSession, landing_path: str, table: str, points: DataFrame, end: dt.date,
                    backfill_years: int = 5, lookback_days: int = 30, force_full: bool = False,
                    measures: tuple[str, ...] = GRID_MEASURES, layout: str = "lines", rejects: str | None = None) -> DataFrame:
    """Gridded weather: plan the window per point, read landed payloads, merge, store by year.

    Payloads that cannot be used are appended to the table ``rejects``, if one is named, before the merge: a run that
    is repeated may list them again, but none is lost.
    """
    keys = ["latitude", "longitude"]
    plan = latest.refresh_plan(points, tables.last_days(spark, table, keys), end, backfill_years, lookback_days, force_full)
    rows, unusable = records.read_weather(spark, landing_path, measures, layout)
    if rejects:
        _keep_rejects(records.weather_rejects(unusable), end, rejects)
    tables.upsert_table(spark, table, _inside_window(rows, plan, keys), latest.WEATHER_KEYS)
    return summaries.weather_summary(tables.read_table(spark, table))


def refresh_station_weather(spark: SparkSession, stations_path: str, records_path: str, table: str, sites: DataFrame,
                            end: dt.date, backfill_years: int = 5, lookback_days: int = 14, force_full: bool = False,
                            stations_layout: str = "array", records_layout: str = "lines",
                            station_key: str = "station", rejects: str | None = None) -> DataFrame:
    """Station weather: the station nearest to each site, its observations in the window, merge, store by year.

    Sites carry id, lat, lon; observation records carry the station id under ``station_key``. Records without a date are
    appended to the table ``rejects``, if one is named, as in ``refresh_weather``.
    """
    if rejects:
        _keep_rejects(records.undated_station_records(spark, records_path, records_layout), end, rejects)
    stations = records.read_stations(spark, stations_path, stations_layout)
    chosen = spatial.nearest(sites, stations, 1, "haversine", tie_break=["id_station"])
    chosen = chosen.select("id_station", "latitude", "longitude").distinct()
    keys = ["latitude", "longitude"]
    plan = latest.refresh_plan(chosen.select(*keys).distinct(), tables.last_days(spark, table, keys), end, backfill_years,
                               lookback_days, force_full)
    observed = records.read_station_records(spark, records_path, records_layout, keep=(station_key,))
    placed = observed.join(chosen, observed[station_key] == chosen["id_station"]).drop(station_key, "id_station")
    tables.upsert_table(spark, table, _inside_window(placed, plan, keys), latest.WEATHER_KEYS)
    return summaries.weather_summary(tables.read_table(spark, table))


def _readable(manifest: DataFrame, years: list[int]) -> dict[str, list[str]]:
    """Paths of the wanted years by format, in (year, quarter) order."""
    out: dict[str, list[str]] = {}
    for row in filters.files_of_years(manifest, years).select("format", "path").collect():
        out.setdefault(row.format, []).append(landing.unquote(row.path))
    return out


def _load_landed(spark: SparkSession, path: str, years: list[int], file_year, manifest_of, read_files,
                 read_archives) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted years and the files or archive members that could not be read (path, member, error)."""
    paths = _readable(landing.file_manifest(spark, path, file_year), years)
    rows, errors = read_archives(spark, paths.get("ZIP", []))
    if "CSV" in paths:
        rows = concat([read_files(spark, manifest_of(spark, paths["CSV"])), rows])
    return rows, errors


def _quarantine(errors: DataFrame, path: str | None) -> None:
    if path is not None:
        tables.write_all(errors, path)


def _summary_of(spark: SparkSession, table: str, schema: T.StructType, summary) -> DataFrame:
    return summary(tables.read_table(spark, table, schema))


def load_quotes(spark: SparkSession, landing_path: str, table: str, years: list[int],
                markets: list[str] | None = None, stages: list[str] | None = None,
                quarantine: str | None = None) -> DataFrame:
    """Market quotes of the wanted years: files and archives, one schema, filters, stored by year.

    What cannot be read is skipped, and listed in the table ``quarantine`` if given; without a row the stored table
    stays as it is. No file of these years, of whatever format, is an error.
    """
    quotes, errors = _load_landed(spark, landing_path, years, landing.text.quote_file_year, landing.quote_manifest,
                                  landing.read_quotes, archives.read_quote_archives)
    _quarantine(errors, quarantine)
    tables.replace_unless_empty(filters.quotes_of(quotes, markets, stages), table, "annee", ["produit", "marche"])
    return _summary_of(spark, table, PRICE_QUOTES, summaries.quote_summary)


def load_sales(spark: SparkSession, landing_path: str, table: str, years: list[int],
               departments: list[str] | None = None, lat: float | None = None, lon: float | None = None,
               radius_km: float | None = None, dedupe: bool = True, quarantine: str | None = None) -> DataFrame:
    """Land sales of the wanted years: filters, optional full-row distinct, stored by year. Else as ``load_quotes``."""
    sales, errors = _load_landed(spark, landing_path, years, landing.text.year_in_text, landing.sale_manifest,
                                 landing.read_sales, archives.read_sale_archives)
    _quarantine(errors, quarantine)
    kept = filters.sales_of(sales, departments, lat, lon, radius_km)
    if dedupe:
        kept = summaries.distinct_rows(kept)
    tables.replace_unless_empty(kept, table, "annee", ["code_departement", "latitude"])
    return _summary_of(spark, table, LAND_SALES, summaries.rows_per)


def load_crop_parcels(spark: SparkSession, landing_path: str, table: str, year: int, lat: float, lon: float,
                      radius_km: float, layout: str = "lines", lambert93: bool = False) -> DataFrame:
    """Crop parcels of a year in the box around a site, stored by year; returns that year's ten largest crops.

    Other years stay, and so does this year's if nothing was found. ``lambert93`` tells that files are in EPSG:2154.
    """
    features = records.read_features(spark, landing_path, layout)
    if lambert93:
        features = records.features_from_lambert93(features)
    features = records.features_in_box(features, lat, lon, radius_km)
    rows = records.crop_parcel_rows(features).withColumn("annee", F.lit(year))
    tables.replace_unless_empty(rows, table, "annee")
    stored = tables.read_table(spark, table, rows.schema)
    return summaries.top_crops(stored.filter(F.col("annee") == year))


def load_wells(spark: SparkSession, landing_path: str, table: str, lat: float, lon: float, radius_km: float = 25.0,
               layout: str = "lines") -> DataFrame:
    """Wells within the radius of a site; returns wells and mean depth per department."""
    wells = records.read_wells(spark, landing_path, lat, lon, layout)
    near = spatial.within_radius(wells.drop("distance_km"), lat, lon, radius_km)
    kept = near.withColumn("distance_km", rounded("distance_km", 2)).select(*WELLS.fieldNames())
    tables.replace_unless_empty(kept, table, order=["distance_km"])
    return _summary_of(spark, table, WELLS, summaries.wells_per_department)


def nearest_well_codes(wells: DataFrame, n: int | None = None) -> DataFrame:
    """Codes of the n nearest wells (all without n)."""
    listed = wells if n is None else spatial.nearest_listing(wells, n)
    return listed.select("code_bss").filter(F.col("code_bss").isNotNull()).distinct()


def measures_of_nearest(groundwater: DataFrame, wells: DataFrame, n: int | None = None) -> DataFrame:
    """Groundwater measures of the n nearest wells."""
    return groundwater.join(nearest_well_codes(wells, n), "code_bss", "left_semi")


def load_groundwater(spark: SparkSession, landing_path: str, wells_table: str, table: str, until: dt.date,
                     since_year: int | None = None, n_stations: int | None = None, layout: str = "lines") -> DataFrame:
    """Measures of the nearest wells since a year (ten years back by default); returns the station summary."""
    wells = tables.read_table(spark, wells_table)
    if wells is None:
        raise FileNotFoundError(f"no wells table at {wells_table}; load wells first")
    measures = records.read_groundwater(spark, landing_path, layout)
    window = F.col("date_mesure").between(since_date(until, since_year), F.lit(until))
    kept = measures_of_nearest(measures, wells, n_stations).filter(window)
    tables.replace_unless_empty(kept, table, order=["code_bss", "date_mesure"])
    return _summary_of(spark, table, GROUNDWATER, summaries.groundwater_per_station)


def load_hours(spark: SparkSession, log_path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Work-hour log to its typed table; returns the total and the per-task summary."""
    tables.write_all(hours.typed_hours(landing.read_work_log(spark, log_path)), table)
    stored = spark.read.parquet(table)
    return summaries.hours_summary(stored), summaries.hours_per_task(stored)


def evaluate_parcels(parcels: DataFrame, weather: DataFrame | None, sales: DataFrame | None, wells: DataFrame | None,
                     weights: dict[str, float] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(ranked parcels, quarantine): validate, enrich, score, rank.

    The quarantine needs ``errors`` on the parcels or is found from the constraints.
    """
    valid, quarantine = split_parcels(parcels)
    enriched = enrichment.enrich(valid, weather, sales, wells, **options)
    scored = scoring.score_parcels(enriched, weights)
    return scoring.rank_scores(scoring.with_verdict(scored)), quarantine


def price_dashboard(quotes: DataFrame, products: list[str], markets: list[str] | None = None,
                    every: str = "week") -> dict[str, DataFrame]:
    """All tables of the price page for a selection of products and markets."""
    selected = prices.select_quotes(prices.display_quotes(quotes), products, markets)
    everything = selected.withColumn("_all", F.lit(0))
    return {
        "metrics": prices.selection_metrics(selected),
        "trend": prices.price_trend(everything, ["_all"]).drop("_all"),
        "series": prices.price_series_wide(selected, products, every),
        "distribution": prices.price_distribution(selected),
        "seasonality": prices.seasonality_wide(selected),
        "latest": prices.latest_quotes(selected),
    }


def lake_status(spark: SparkSession, sources: dict[str, tuple[str, Column]], ref_date: dt.date) -> DataFrame:
    """Freshness of each source: name -> (table path, date column to take the latest of).

    All sources are one job. If it fails, each half of them is one, and so on, so a source that cannot be read, for whatever
    reason (no files, a damaged file, a missing column), gives an error row and the others stay.
    """
    def rows(named: list[str]) -> list:
        try:
            parts = []
            for name in named:
                path, last = sources[name]
                df = tables.read_table(spark, path)
                parts.append(summaries.failed_source(spark, name, f"no files found at {path}") if df is None
                             else summaries.source_status(df, name, last, ref_date))
            return concat(parts).collect()
        except (PySparkException, Py4JJavaError) as problem:
            if len(named) == 1:
                return summaries.failed_source(spark, named[0], _first_words(problem)).collect()
            half = len(named) // 2
            return rows(named[:half]) + rows(named[half:])

    return spark.createDataFrame(rows(list(sources)) if sources else [], summaries.STATUS)


def _first_words(problem: Exception) -> str:
    named = problem.getCondition() if isinstance(problem, PySparkException) else None
    return named or str(problem).splitlines()[0]


def weather_series(grid: DataFrame, station: DataFrame | None = None, start: dt.date | None = None,
                   end: dt.date | None = None) -> DataFrame:
    """Weather for display in date order: both sources on one schema, optional date range."""
    shown = filters.date_range(grid, start, end)
    if station is None:
        return conform.display_weather(shown).orderBy("date")
    return conform.both_sources(shown, filters.date_range(station, start, end)).orderBy("date", "source")
