"""Distances, boxes, well-known text and point-in-polygon as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None,
              cos2: Column | None = None) -> Column:
    """Haversine of the angle between two points, from 0 to 1: a quarter of their squared chord."""
    cos1, cos2 = (F.cos(F.radians(lat)) if c is None else c for c, lat in ((cos1, lat1), (cos2, lat2)))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    return F.pow(F.sin(half_lat), F.lit(2.0)) + (
        cos1 * cos2 * F.pow(F.sin(half_lon), F.lit(2.0))
    )


def km_of_haversine(a: Column) -> Column:
    # Rounding can push antipodes past 1; ``least`` would hide a missing coordinate.
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None,
                 cos2: Column | None = None) -> Column:
    """Great-circle distance in km on a sphere of radius 6371. The cosines of the latitudes may be given, where many
    pairs share them."""
    return km_of_haversine(haversine(lat1, lon1, lat2, lon2, cos1, cos2))


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar metric on raw degrees, for ranking only."""
    return F.pow(lat2 - lat1, F.lit(2.0)) + F.pow(lon2 - lon1, F.lit(2.0))


def bounding_box(lat: Column, lon: Column, radius_km: Column | float) -> dict[str, Column]:
    """Box around a point at 111.32 km per degree."""
    radius = F.lit(radius_km).cast("double") if not isinstance(radius_km, Column) else radius_km
    dlat = radius / F.lit(KM_PER_DEGREE)
    dlon = radius / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return {"lon_min": lon - dlon, "lat_min": lat - dlat, "lon_max": lon + dlon, "lat_max": lat + dlat}


def bounding_box_of(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """The same box for one known point, as numbers that can be pushed to the file scan."""
    dlat = radius_km / KM_PER_DEGREE
    dlon = radius_km / (KM_PER_DEGREE * abs(math.cos(math.radians(lat))))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def _number_text(x: Column) -> Column:
    """Decimal text without an exponent for coordinates close to zero."""
    plain = F.rtrim(x.cast("decimal(30,15)").cast("string"), F.lit("0"))
    return F.when((F.abs(x) < 1e-3) & (x != 0), plain).otherwise(x.cast("string"))


def _ring_text(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.concat_ws(" ", _number_text(p[0]), _number_text(p[1])))
    return F.concat(F.lit("("), F.array_join(points, ","), F.lit(")"))


def _polygon_text(rings: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(rings, _ring_text), ","), F.lit(")"))


POLYGON_JSON = "array<array<array<double>>>"
MULTIPOLYGON_JSON = "array<array<array<array<double>>>>"


# The ellipsoid GRS 80 and the projection EPSG:2154 (Lambert-93), as published: semi-major axis, inverse
# flattening, latitude and longitude of the origin, standard parallels, false easting and northing.
GRS80_AXIS, GRS80_FLATTENING = 6378137.0, 1 / 298.257222101
LAMBERT93_ORIGIN = (46.5, 3.0)
LAMBERT93_PARALLELS = (44.0, 49.0)
LAMBERT93_FALSE = (700000.0, 6600000.0)


def _lambert93_cone() -> tuple[float, float, float, float]:
    """Eccentricity, exponent of the cone, its scale, and the distance of the origin from the apex."""
    e = math.sqrt(GRS80_FLATTENING * (2 - GRS80_FLATTENING))

    def isometric(lat: float) -> float:
        return math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))

    def parallel_radius(lat: float) -> float:
        return GRS80_AXIS * math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    south, north = map(math.radians, LAMBERT93_PARALLELS)
    exponent = math.log(parallel_radius(south) / parallel_radius(north)) / (isometric(north) - isometric(south))
    scale = parallel_radius(south) * math.exp(exponent * isometric(south)) / exponent
    return e, exponent, scale, scale * math.exp(-exponent * isometric(math.radians(LAMBERT93_ORIGIN[0])))


def lambert93_to_degrees(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of Lambert-93 metres; null for a missing coordinate.

    The latitude comes from the conformal latitude by its series to the eighth power of the eccentricity, so there is no
    loop; the error is below 0.1 mm.
    """
    e, exponent, scale, apex = _lambert93_cone()
    x, y = easting - LAMBERT93_FALSE[0], F.lit(apex + LAMBERT93_FALSE[1]) - northing
    isometric = F.log(F.try_divide(F.lit(scale), F.sqrt(x * x + y * y))) / exponent
    conformal = F.lit(math.pi / 2) - 2 * F.atan(F.exp(-isometric))
    series = (
        e**2 / 2 + 5 * e**4 / 24 + e**6 / 12 + 13 * e**8 / 360,
        7 * e**4 / 48 + 29 * e**6 / 240 + 811 * e**8 / 11520,
        7 * e**6 / 120 + 81 * e**8 / 1120,
        4279 * e**8 / 161280,
    )
    lat = conformal
    for i, factor in enumerate(series):
        lat = lat + F.lit(factor) * F.sin(conformal * (2.0 * (i + 1)))
    return F.degrees(F.atan2(x, y)) / exponent + LAMBERT93_ORIGIN[1], F.degrees(lat)


def lambert93_shape(kind: Column, coordinates: Column, decimals: int = 9) -> Column:
    """GeoJSON coordinates text of a Polygon or MultiPolygon in Lambert-93 as the same text in degrees, longitude first,
    rounded (nine decimals are 0.1 mm). Heights are dropped; coordinates of other kinds, and texts that cannot be read, give null.
    """

    def point(p: Column) -> Column:
        return F.array(*(F.round(c, decimals) for c in lambert93_to_degrees(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))

    def polygon(rings: Column) -> Column:
        return F.transform(rings, lambda ring: F.transform(ring, point))

    single = F.to_json(polygon(F.from_json(coordinates, POLYGON_JSON)))
    several = F.to_json(F.transform(F.from_json(coordinates, MULTIPOLYGON_JSON), polygon))
    return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", several)


def polygons(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text as a list of polygons (each a list of rings); null for other kinds."""
    single = F.from_json(coordinates, POLYGON_JSON)
    several = F.from_json(coordinates, MULTIPOLYGON_JSON)
    return F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", several)


def wkt(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon as well-known text; the empty text for anything else."""
    parts = F.transform(polygons(kind, coordinates), _polygon_text)
    text = F.when(kind == "Polygon", F.concat(F.lit("POLYGON"), parts[0])).when(
        kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON("), F.array_join(parts, ","), F.lit(")"))
    )
    return F.coalesce(text, F.lit(""))


def points_of(shape: Column) -> Column:
    """All points of a polygon list."""
    return F.flatten(F.flatten(shape))


def envelope(shape: Column) -> dict[str, Column]:
    """Smallest box around all points of a polygon list."""
    return box_of_points(points_of(shape))


def box_of_points(points: Column) -> dict[str, Column]:
    """Smallest box around a list of points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return {
        "lon_min": F.array_min(xs), "lat_min": F.array_min(ys),
        "lon_max": F.array_max(xs), "lat_max": F.array_max(ys),
    }


def edges(shape: Column) -> Column:
    """All edges of all rings of a polygon list: array of (x1, y1, x2, y2). A ring that is not closed is closed."""

    def of_ring(ring: Column) -> Column:
        starts = F.slice(ring, F.lit(1), F.size(ring))
        ends = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))

    return F.flatten(F.transform(F.flatten(shape), of_ring))


def within_edges(sides: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against edges (holes count as outside). Only edges that reach the point's latitude and
    do not lie to its left matter."""

    def crosses(e: Column) -> Column:
        spans = (e.y1 > lat) != (e.y2 > lat)
        # The division is only reached when the edge is not horizontal.
        at = F.when(spans, e.x1 + (lat - e.y1) * (e.x2 - e.x1) / F.nullif(e.y2 - e.y1, F.lit(0.0)))
        return spans & (lon < at)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def inside(shape: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against all rings of a polygon list (holes count as outside)."""
    return within_edges(edges(shape), lon, lat)
