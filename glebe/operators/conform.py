"""Bring drifting inputs into a fixed schema: names, types, units, sentinels, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.functions import text
from glebe.functions.dates import iso_date
from glebe.functions.numbers import rounded
from glebe.schemas import (
    CROP_LABELS, LAND_SALE_ALIASES, LAND_SALES, PRICE_QUOTE_ALIASES, PRICE_QUOTES, QUOTE_NULL_TOKENS,
    STATION_FIELDS, STATION_MISSING, UNKNOWN_CROP,
)


def resolve_names(columns: list[str], targets: list[str], aliases: dict[str, list[str]],
                  order: str = "input", fan_out: bool = False) -> dict[str, str]:
    """Target name -> input column, ignoring case and blanks around header names.

    A column named like a target always serves that target alone. Otherwise ``order`` "input" takes the
    first input column among the aliases, "alias" the first alias among the inputs. An input column that
    fits several targets goes to the last of them, or to all with ``fan_out``.
    """
    if order not in ("input", "alias"):
        raise ValueError(f"unknown order {order!r}")
    by_name: dict[str, str] = {}
    for column in columns:
        by_name.setdefault(column.strip().lower(), column)
    found = {t: by_name[t.lower()] for t in targets if t.lower() in by_name}
    exact = set(found.values())
    drifting = {}
    for target in targets:
        if target in found:
            continue
        names = [a.lower() for a in aliases.get(target, [target])]
        search = list(by_name) if order == "input" else names
        accepted = set(names if order == "input" else by_name)
        hit = next((by_name[n] for n in search if n in accepted and by_name[n] not in exact), None)
        if hit is not None:
            drifting[target] = hit
    if not fan_out:
        last_target = {source: target for target, source in drifting.items()}
        drifting = {t: s for t, s in drifting.items() if last_target[s] == t}
    return {**found, **drifting}


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, list[str]], to_double: Callable[[Column], Column],
            order: str = "input", null_tokens: list[str] | None = None, fan_out: bool = False,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """All-text input to the target schema in one projection.

    Numbers go through ``to_double`` or a lenient int; missing columns become typed nulls; other columns
    are dropped except ``keep``.
    """
    inputs = [c for c in df.columns if c not in keep]
    names = resolve_names(inputs, schema.fieldNames(), aliases, order, fan_out)

    def target(field: T.StructField) -> Column:
        if field.name not in names:
            return F.lit(None).cast(field.dataType).alias(field.name)
        raw = F.col(f"`{names[field.name]}`").cast("string")
        if null_tokens:
            raw = text.null_if_token(raw, null_tokens)
        if isinstance(field.dataType, T.DoubleType):
            return to_double(raw).alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            return text.lenient_int(raw).alias(field.name)
        return raw.cast(field.dataType).alias(field.name)

    return df.select(*(target(f) for f in schema), *keep)


def conform_quotes(df: DataFrame, keep: tuple[str, ...] = (), fan_out: bool = False) -> DataFrame:
    """Market-quote text columns to ``price_quotes``: null tokens, first comma is the decimal mark."""
    return conform(df, PRICE_QUOTES, PRICE_QUOTE_ALIASES, text.decimal_comma_number, "input",
                   QUOTE_NULL_TOKENS, fan_out, keep)


def conform_sales(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Land-sale text columns to ``land_sales``: French numbers, empty text is missing."""
    return conform(df, LAND_SALES, LAND_SALE_ALIASES, text.french_number, "alias", [""], keep=keep)


def fill_quote_year(quotes: DataFrame, file: str = "_file", file_year: str = "_file_year") -> DataFrame:
    """Year of quotes from files that have none.

    Per file: if every ``annee`` is null, the first four digits of ``date`` give the year when any row has
    them (rows without stay null), else the year of the file name. One small row per file is broadcast and joined
    back, so rows are not shuffled and a large file is never gathered in one task.
    """
    in_date = F.nullif(F.regexp_extract("date", r"(\d{4})", 1), F.lit("")).try_cast("int")
    files = quotes.groupBy(file).agg(
        F.max(F.col("annee").isNotNull()).alias("_has_year"),
        F.max(in_date.isNotNull()).alias("_has_date"),
    )
    year = (
        F.when(F.col("_has_year"), F.col("annee"))
        .when(F.col("_has_date"), in_date)
        .otherwise(F.col(file_year))
    )
    return quotes.join(F.broadcast(files), file).withColumn("annee", year).drop("_has_year", "_has_date", file_year)


def fill_sale_period(sales: DataFrame, year: Column | None = None, quarter: Column | None = None) -> DataFrame:
    """Year and quarter of sales: as given for the file, else from the mutation date."""
    day = iso_date(F.col("date_mutation"))
    nothing = F.lit(None).cast("int")
    return sales.withColumns({
        "annee": F.coalesce(nothing if year is None else year, F.year(day)),
        "trimestre": F.coalesce(nothing if quarter is None else quarter, F.quarter(day)),
    })


def station_measures(raw: dict[str, Column]) -> list[Column]:
    """Raw station fields (text) to project measures: sentinel to null, unit factor, two decimals."""
    out = []
    for field, (measure, factor) in STATION_FIELDS.items():
        value = text.lenient_double(raw[field])
        out.append(rounded(F.nullif(value, F.lit(STATION_MISSING)) * F.lit(factor), 2).alias(measure))
    return out


def crop_label(code: Column) -> Column:
    """Crop name of a code, "Inconnu" when the code is not listed."""
    return text.map_label(code, CROP_LABELS, UNKNOWN_CROP)


def with_label(df: DataFrame, codes: DataFrame, code: str, label: str, default: str) -> DataFrame:
    """Left join with a code table (columns ``code`` and ``label``) and a default for unknown codes."""
    lookup = codes.select(F.col(code).alias("_code"), F.col(label).alias("_label"))
    return (
        df.join(lookup, F.col(code) == F.col("_code"), "left")
        .withColumn(label, F.coalesce("_label", F.lit(default))).drop("_code", "_label")
    )


# Measure -> display name.
DISPLAY_NAMES = {
    "temperature_2m_max": "t_max",
    "temperature_2m_min": "t_min",
    "temperature_2m_mean": "t_moy",
    "precipitation_sum": "pluie_mm",
    "et0_fao_evapotranspiration": "etp_mm",
    "wind_speed_10m_max": "vent_kmh",
    "shortwave_radiation_sum": "rayonnement_mj",
    "sunshine_duration_min": "ensoleillement_min",
}


def display_weather(weather: DataFrame, keep: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weather of either source under display names."""
    present = [c for c in DISPLAY_NAMES if c in weather.columns]
    return weather.select(*keep, *(F.col(c).alias(DISPLAY_NAMES[c]) for c in present))


def both_sources(grid: DataFrame, station: DataFrame, keep: tuple[str, ...] = ("date",)) -> DataFrame:
    """Gridded and station weather on one display schema, with the source named."""
    return display_weather(grid, keep).withColumn("source", F.lit("grille")).unionByName(
        display_weather(station, keep).withColumn("source", F.lit("station")), allowMissingColumns=True)


def concat(frames: list[DataFrame], relaxed: bool = False) -> DataFrame:
    """Rows of all frames; ``relaxed`` takes the union of the columns and widens numbers to double."""
    if not frames:
        raise ValueError("nothing to concatenate")
    if relaxed:
        wide = {}
        for df in frames:
            for f in df.schema:
                known = wide.setdefault(f.name, f.dataType)
                if known != f.dataType:
                    numeric = isinstance(known, T.NumericType) and isinstance(f.dataType, T.NumericType)
                    wide[f.name] = T.DoubleType() if numeric else T.StringType()
        frames = [df.select(*(F.col(f"`{c}`").cast(wide[c]).alias(c) for c in df.columns)) for df in frames]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=relaxed)
    return out


def place_constant(df: DataFrame, lat: float | Column, lon: float | Column, first: tuple[str, ...] = ("date",)) -> DataFrame:
    """Attach one coordinate to all rows, then order: date, coordinates, the rest."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    placed = df.withColumns({"latitude": as_column(lat), "longitude": as_column(lon)})
    rest = [c for c in placed.columns if c not in (*first, "latitude", "longitude")]
    return placed.select(*first, "latitude", "longitude", *rest)
