import json
import math

import pytest
from pyspark.sql import functions as F

from glebe.functions import geo
from glebe.plans import jobs
from glebe.sources import records
from helpers import values

E = math.sqrt(geo.GRS80_FLATTENING * (2 - geo.GRS80_FLATTENING))


def degrees(spark, points):
    lon, lat = geo.lambert93_to_degrees(F.col("x"), F.col("y"))
    return values(spark, F.array(lon, lat), points, "x double, y double")


def metres(lon, lat):
    """The projection itself, in plain numbers: radius of the cone at a latitude, angle at a longitude."""
    def shrunk(phi):
        return math.tan(math.pi / 4 - phi / 2) / ((1 - E * math.sin(phi)) / (1 + E * math.sin(phi))) ** (E / 2)

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (E * math.sin(phi)) ** 2)

    a, b, o = map(math.radians, (44, 49, 46.5))
    n = math.log(m(a) / m(b)) / math.log(shrunk(a) / shrunk(b))
    radius, apex = (6378137 * m(a) / n * (shrunk(p) / shrunk(a)) ** n for p in (math.radians(lat), o))
    return 700000 + radius * math.sin(n * math.radians(lon - 3)), 6600000 + apex - radius * math.cos(n * math.radians(lon - 3))


def test_points_of_the_country(spark):
    places = [(lon, lat) for lon in (-9.5, -5.1, -0.3, 3.0, 6.77, 10.1) for lat in (41.0, 44.0, 46.5, 48.8584, 49.0, 51.6)]
    for got, want in zip(degrees(spark, [metres(*p) for p in places]), places, strict=True):
        assert got == pytest.approx(want, abs=1e-9)
    origin, tower = degrees(spark, [(700000.0, 6600000.0), (648237.0, 6862271.0)])
    assert origin == pytest.approx([3.0, 46.5], abs=1e-10)
    assert tower == pytest.approx([2.2945, 48.8584], abs=1e-3)
    assert degrees(spark, [(None, 6600000.0)]) == [[None, None]]


def test_lengths_are_true_on_both_parallels(spark):
    for lat in (44.0, 49.0):
        (x0, y0), (x1, y1) = metres(3.0, lat), metres(3.01, lat)
        radius = 6378137 * math.cos(math.radians(lat)) / math.sqrt(1 - (E * math.sin(math.radians(lat))) ** 2)
        assert math.hypot(x1 - x0, y1 - y0) == pytest.approx(math.radians(0.01) * radius, rel=1e-8)


def feature(kind, coordinates, name="P1"):
    return json.dumps({"properties": {"ID_PARCEL": name, "CODE_CULTU": "11"}, "geometry": {"type": kind, "coordinates": coordinates}})


RING = [[700000, 6600000], [700100, 6600000], [700100, 6600100], [700000, 6600000]]


def test_features(spark, tmp_path):
    lines = [feature("Polygon", [RING], "a"), feature("MultiPolygon", [[[[*p, 12.5] for p in RING]], [RING]], "b"),
             feature("Point", [700000, 6600000], "c"), feature("Polygon", [[[700000], []]], "d"),
             json.dumps({"properties": {"ID_PARCEL": "e"}, "geometry": None}), "broken"]
    (tmp_path / "parcels.json").write_text("\n".join(lines))
    features = records.features_from_lambert93(records.read_features(spark, str(tmp_path)))
    got = {r.id_parcel: r.geometry_wkt for r in records.crop_parcel_rows(features).collect()}
    assert got["a"].startswith("POLYGON((3.0 46.5,3.0013") and got["b"].startswith("MULTIPOLYGON(((3.0 46.5,3.0013")
    assert got["b"].count("((") == 2 and got["c"] == got["e"] == got[""] == ""
    near = records.features_in_box(features, 46.5, 3.0, 5)
    assert {r.n for r in near.select(F.col("properties")["ID_PARCEL"].alias("n")).collect()} == {"a", "b"}
    assert records.features_in_box(features, 47.5, 3.0, 5).count() == 0


def test_job(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "parcels.json").write_text(feature("Polygon", [RING]))
    top = jobs.load_crop_parcels(spark, str(tmp_path / "landed"), str(tmp_path / "table"), 2024, 46.5, 3.0, 5, lambert93=True)
    assert [r.n for r in top.collect()] == [1]
