"""Landed JSON: weather payloads, station records, wells, groundwater, crop parcels, parcel documents.

``layout`` says how records lie in the files: "lines" (one per line), "array" (one JSON list per file) or "data" (a list
under the key ``data``, as the water API pages have it). Files of any layout are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.functions import geo, text
from glebe.functions.dates import iso_date
from glebe.operators.conform import crop_label, place_constant, station_measures
from glebe.operators.spatial import with_distance
from glebe.operators.validate import broken_rules, with_defaults
from glebe.schemas import GRID_MEASURES, GROUNDWATER, PARCELS, STATION_FIELDS, WELLS
from glebe.sources.json_records import json_records

_FIELDS = "map<string,string>"
# Layouts of lists, and the key that the list stands under.
_LIST_KEYS = {"array": None, "data": "data", "collection": "features"}


def _records(spark: SparkSession, path: str, schema: T.StructType, layout: str) -> DataFrame:
    """Records with declared fields."""
    if layout == "lines":
        return spark.read.schema(schema).json(path)
    return _listed(spark, path, layout).select(F.from_json("value", schema).alias("r")).select("r.*")


def _listed(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Records of JSON lists as text."""
    if layout not in _LIST_KEYS:
        raise ValueError(f"unknown layout {layout!r}")
    return json_records(spark, path, _LIST_KEYS[layout])


def _maps(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Records as text maps (``r``), for sources whose field names vary in case."""
    texts = spark.read.text(path) if layout == "lines" else _listed(spark, path, layout)
    return texts.select(F.from_json("value", _FIELDS).alias("r")).filter(F.col("r").isNotNull())


def _field(name: str):
    return F.try_element_at("r", F.lit(name))


# ---- weather ----------------------------------------------------------------------------------------


def weather_payload_schema(measures: tuple[str, ...] = GRID_MEASURES) -> T.StructType:
    daily = T.StructType([T.StructField("time", T.ArrayType(T.StringType())),
                          *(T.StructField(m, T.ArrayType(T.DoubleType())) for m in measures)])
    return T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
                         T.StructField("daily", daily), T.StructField("_corrupt_record", T.StringType())])


def weather_rows(payloads: DataFrame, measures: tuple[str, ...] = GRID_MEASURES) -> DataFrame:
    """Column-array payloads to one row per day: date, latitude, longitude, measures.

    A measure that a payload lacks is null on all its days.
    """
    none = F.array().cast("array<double>")
    days = F.arrays_zip(F.col("daily.time").alias("time"),
                        *(F.coalesce(F.col(f"daily.{m}"), none).alias(m) for m in measures))
    return (
        payloads.filter(F.col("daily.time").isNotNull())
        .select("latitude", "longitude", F.inline(days))
        .select(F.try_to_date("time", "yyyy-MM-dd").alias("date"), "latitude", "longitude", *measures)
    )


def read_weather(spark: SparkSession, path: str, measures: tuple[str, ...] = GRID_MEASURES,
                 layout: str = "lines") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected payloads): a payload without ``daily.time`` is rejected."""
    payloads = _records(spark, path, weather_payload_schema(measures), layout)
    return weather_rows(payloads, measures), payloads.filter(F.col("daily.time").isNull())


def read_station_records(spark: SparkSession, path: str, layout: str = "lines", keep: tuple[str, ...] = ()) -> DataFrame:
    """Station observations: date, the six shared measures, sunshine minutes. Records without date are dropped.

    ``keep`` names further raw fields to carry along, such as the station id.
    """
    day = iso_date(text.first_non_empty(_field("reference_time"), _field("DATE"), _field("date")))
    measures = station_measures({f: _field(f) for f in STATION_FIELDS})
    rows = _maps(spark, path, layout).select(day.alias("date"), *measures, *(_field(k).alias(k) for k in keep))
    return rows.filter(F.col("date").isNotNull())


def rejects(records: DataFrame, reason: str, content: Column) -> DataFrame:
    """Rows for a table of rejects: ``raison`` and ``contenu`` (the record as text)."""
    return records.select(F.lit(reason).alias("raison"), content.alias("contenu"))


def weather_rejects(payloads: DataFrame) -> DataFrame:
    """Rejected payloads of ``read_weather`` for a table of rejects: the text itself where it was no JSON."""
    return rejects(payloads, "no daily.time", F.coalesce("_corrupt_record", F.to_json(F.struct("latitude", "longitude", "daily"))))


def undated_station_records(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """The records that ``read_station_records`` drops, for a table of rejects."""
    day = iso_date(text.first_non_empty(_field("reference_time"), _field("DATE"), _field("date")))
    return rejects(_maps(spark, path, layout).filter(day.isNull()), "no date", F.to_json("r"))


def station_weather(records: DataFrame, lat: float, lon: float) -> DataFrame:
    """Observations of one station placed at its coordinates, in date order. No valid row is an error."""
    if records.isEmpty():
        raise ValueError("no station record with a date")
    return place_constant(records, lat, lon).orderBy("date")


def read_stations(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """Station list with varying key names: id_station, nom, latitude, longitude, altitude."""
    def coordinate(*names: str):
        return F.coalesce(*(text.lenient_double(_field(n)) for n in names))

    return _maps(spark, path, layout).select(
        text.first_non_empty(_field("id"), _field("ID"), _field("id_station")).alias("id_station"),
        text.first_non_empty(_field("nom"), _field("name"), _field("Nom")).alias("nom"),
        coordinate("lat", "latitude", "Latitude").alias("latitude"),
        coordinate("lon", "longitude", "Longitude").alias("longitude"),
        text.lenient_double(_field("altitude")).alias("altitude"),
    )


# ---- water ------------------------------------------------------------------------------------------

_TEXT_FIELDS = ("code_bss", "bss_id", "libelle_pe", "nom_commune", "code_commune_insee", "code_departement",
                "nom_departement", "x", "y", "altitude_station", "profondeur_investigation", "date_debut_mesure",
                "date_fin_mesure", "nb_mesures_piezo")
_WELL_RECORD = T.StructType([
    *(T.StructField(f, T.StringType()) for f in _TEXT_FIELDS),
    T.StructField("codes_bdlisa", T.ArrayType(T.StringType())),
    T.StructField("noms_masse_eau_edl", T.ArrayType(T.StringType())),
])


def well_rows(records: DataFrame, lat: float, lon: float) -> DataFrame:
    """Well records to the 17-column table with the distance (2 decimals) from a site."""
    number = {c: text.lenient_double(F.col(s)) for c, s in (
        ("longitude", "x"), ("latitude", "y"), ("altitude_station", "altitude_station"),
        ("profondeur_investigation", "profondeur_investigation"))}
    typed = records.withColumns({
        **number,
        "nb_mesures_piezo": text.lenient_long(F.col("nb_mesures_piezo")),
        "code_bdlisa": text.first_item(F.col("codes_bdlisa")),
        "nom_masse_eau": text.first_item(F.col("noms_masse_eau_edl")),
    })
    return with_distance(typed, lat, lon, decimals=2).select(*WELLS.fieldNames())


def read_wells(spark: SparkSession, path: str, lat: float, lon: float, layout: str = "lines") -> DataFrame:
    return well_rows(_records(spark, path, _WELL_RECORD, layout), lat, lon)


def groundwater_rows(records: DataFrame) -> DataFrame:
    """Measure records (text fields) to typed rows; bad values become null."""
    return records.select(
        "code_bss", iso_date(F.col("date_mesure")).alias("date_mesure"),
        text.lenient_double(F.col("profondeur_nappe")).alias("profondeur_nappe"),
        text.lenient_double(F.col("niveau_eau_ngf")).alias("niveau_eau_ngf"),
        "mode_obtention", "qualification", text.lenient_long(F.col("code_qualification")).alias("code_qualification"),
    )


def read_groundwater(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Groundwater measures."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in GROUNDWATER.fieldNames()])
    return groundwater_rows(_records(spark, path, schema, layout))


# ---- crop parcels -----------------------------------------------------------------------------------

_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_features(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """GeoJSON features: ``properties`` and ``geometry``; one per line, or a FeatureCollection per file."""
    texts = spark.read.text(path) if layout == "lines" else _listed(spark, path, layout)
    # A list of one keeps the text from being read again for every use of its parts, as in filters.
    return texts.select(F.explode(F.array(F.from_json("value", _FEATURE))).alias("f")).select("f.*")


def features_from_lambert93(features: DataFrame) -> DataFrame:
    """Features delivered in Lambert-93 metres (EPSG:2154) with their polygons in degrees; other shapes are lost."""
    shape = geo.lambert93_shape(F.col("geometry.type"), F.col("geometry.coordinates"))
    return features.withColumn("geometry", F.col("geometry").withField("coordinates", shape))


def crop_parcel_rows(features: DataFrame) -> DataFrame:
    """Features to crop parcels; property names in lower or upper case, missing texts '' and area 0."""
    def prop(name: str):
        return text.first_non_empty(F.try_element_at("properties", F.lit(name)),
                                    F.try_element_at("properties", F.lit(name.upper())))

    code = F.coalesce(prop("code_cultu"), F.lit(""))
    return features.select(
        F.coalesce(prop("id_parcel"), F.lit("")).alias("id_parcel"),
        code.alias("code_culture"),
        F.coalesce(text.lenient_double(prop("surf_parc")), F.lit(0.0)).alias("surface_ha"),
        crop_label(code).alias("libelle_culture"),
        geo.wkt(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometry_wkt"),
    )


def features_in_box(features: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Features whose envelope meets the box around a point; a radius of 0 keeps all."""
    if radius_km <= 0:
        return features
    lon_min, lat_min, lon_max, lat_max = geo.bounding_box_of(lat, lon, radius_km)
    shape = geo.polygons(F.col("geometry.type"), F.col("geometry.coordinates"))

    def meets(points: Column) -> Column:
        box = geo.box_of_points(points)
        return ((box["lon_min"] <= lon_max) & (box["lon_max"] >= lon_min)
                & (box["lat_min"] <= lat_max) & (box["lat_max"] >= lat_min))

    # A list of one: the text is read once for all four borders.
    return features.filter(F.exists(F.array(geo.points_of(shape)), meets))


# ---- parcel documents -------------------------------------------------------------------------------


def _document_schema() -> T.StructType:
    plain = [f.name for f in PARCELS if f.name not in ("lat", "lon")]
    return T.StructType([*(T.StructField(n, T.StringType()) for n in plain),
                         T.StructField("coords_centroid", T.ArrayType(T.StringType())),
                         T.StructField("_corrupt_record", T.StringType())])


def parcel_rows(documents: DataFrame) -> DataFrame:
    """Parcel documents (text fields) to typed parcels with ``errors``; a value of the wrong type is an error."""
    raw = documents.withColumns({"lat": F.get("coords_centroid", F.lit(0)), "lon": F.get("coords_centroid", F.lit(1))})
    typed, wrong = [], []
    for field in PARCELS:
        source = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            value = source
        elif isinstance(field.dataType, T.DoubleType):
            value = text.lenient_double(source)
        else:
            value = source.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        if not isinstance(field.dataType, T.StringType):
            wrong.append(F.when(source.isNotNull() & value.isNull(), F.lit(f"{field.name}: wrong type")))
    rest = [c for c in documents.columns if c not in (*PARCELS.fieldNames(), "coords_centroid")]
    out = raw.select(*typed, F.array_compact(F.array(*wrong)).alias("_wrong"), *rest)
    filled = with_defaults(out)
    return filled.withColumn("errors", F.concat("_wrong", broken_rules(PARCELS.fieldNames()))).drop("_wrong")


def read_parcels(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """All parcel documents, with ``errors``, ``fichier`` and ``modifie``; unreadable ones are skipped.

    ``layout`` "document" is one record per file, "lines" one per line, as ``write_parcels`` leaves them.
    """
    documents = spark.read.schema(_document_schema()).option("multiLine", layout == "document").json(path).select(
        "*", F.col("_metadata.file_path").alias("fichier"), F.col("_metadata.file_modification_time").alias("modifie"))
    readable = documents.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return parcel_rows(readable)


def newest_first(parcels: DataFrame) -> DataFrame:
    """Parcel documents in the order they are listed: newest file first."""
    return parcels.orderBy(F.desc("modifie"), "fichier")


def valid_parcels(parcels: DataFrame) -> DataFrame:
    """Parcels without errors, in the target schema."""
    return parcels.filter(F.size("errors") == 0).select(*PARCELS.fieldNames())


def write_parcels(parcels: DataFrame, path: str) -> None:
    """Append parcels as JSON documents, one folder per department."""
    documents = parcels.withColumn("coords_centroid", F.array("lat", "lon")).drop("lat", "lon")
    kept = documents.withColumn("_departement", F.col("departement"))
    kept.write.mode("append").partitionBy("_departement").json(path)
