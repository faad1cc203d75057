import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from glebe.functions import dates, geo, numbers, text
from helpers import values

D = dt.date


def test_numbers(spark):
    c = F.col("t")
    assert values(spark, text.decimal_comma_number(c), ["0,80", "1,200", "1 200,5", "12.5", "x", None, "12f", "1,2,3"], "t string") == [
        0.8, 1.2, 1200.5, 12.5, None, None, None, None]
    assert values(spark, text.french_number(c), ["125,000", "1,234,567", "125,50", "1 250,5", "125000,5", " 7 ", "", None], "t string") == [
        125000.0, 1234567.0, 125.5, 1250.5, 125000.5, 7.0, None, None]
    assert values(spark, text.lenient_int(c), ["3", "3.7", "invalide", None], "t string") == [3, None, None, None]


def test_quick_rounding_is_rounding(spark):
    xs = [0.0, -0.0, 0.5, 1.5, 2.675, 1.005, 0.4999995, 0.49999949999999994, 1e-7, 19.9999995, 12.3456785, -2.675, -0.0000004, 4503599627.370495,
          4503599627.3704965, 1e300, float("inf"), -float("inf"), float("nan"), None] + [round(i * 0.37 + 5e-7, 7) for i in range(50)]
    plain, quick = (values(spark, f(F.col("x"), 6), xs, "x double") for f in (numbers.rounded, numbers.rounded_quickly))
    assert list(map(repr, plain)) == list(map(repr, quick))


def test_labels_and_lists(spark):
    c = F.col("t")
    assert values(spark, text.short_label(c, 3), ["abc", "abcd"], "t string") == ["abc", "abc…"]
    assert values(spark, text.first_word(c), ["TOMATE RONDE", "AIL", None], "t string") == ["TOMATE", "AIL", None]
    assert values(spark, text.map_label(c, {"15": "x"}, "Inconnu"), ["15", "99", None], "t string") == ["x", "Inconnu", "Inconnu"]
    assert values(spark, text.first_item(F.col("a")), [(["u", "v"],), ([],), (None,)], "a array<string>") == ["u", None, None]
    assert values(spark, text.first_non_empty(F.col("a"), F.col("b")), [("", "z"), ("y", "z"), (None, None)], "a string, b string") == ["z", "y", None]
    assert values(spark, text.null_if_token(c, ["", "NA", "nd", "-"]), ["NA", " nd ", "-", "", "a", None], "t string") == [None, None, None, None, "a", None]


def test_names_of_files(spark):
    c = F.col("t")
    assert values(spark, text.year_in_text(c), ["Cotations 2023", "x/rnm_2022.csv", "cotations", "12023"], "t string") == [2023, 2022, None, None]
    assert values(spark, text.quote_file_year(c), ["COT-A24.zip", "COT-2023-A24.zip", "cot.zip"], "t string") == [2024, 2023, None]
    assert values(spark, text.quarter_in_text(c), ["DVF 2024 T2", "DVF 2024 2ème trimestre", "DVF 2024 Q3", "1er trimestre", "DVF"], "t string") == [2, 2, 3, 1, None]
    assert values(spark, text.clean_department(c), ["072", "72", "10", " 2A", "20"], "t string") == ["72", "72", "10", "2A", "20"]


def test_durations(spark):
    texts = ["2h30", "2h30m", "1.5h", "3h", "90min", "45m", "0.5h", "60min", "2H30", "90MIN", "deux heures", "", "2", None]
    got = values(spark, dates.duration_hours(F.col("t")), texts, "t string")
    assert got == [2.5, 2.5, 1.5, 3.0, 1.5, 0.75, 0.5, 1.0, 2.5, 1.5, None, None, None, None]


def test_relative_dates(spark):
    ref = D(2026, 4, 1)  # a Wednesday
    texts = ["aujourd'hui", "auj", "hier", "2026-04-01", "01/04/2026", "demain", "", None,
             "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche", "Lundi"]
    got = values(spark, dates.relative_date(F.col("t"), F.lit(ref)), texts, "t string")
    assert got[:8] == [ref, ref, D(2026, 3, 31), ref, ref, None, None, None]
    assert got[8:] == [D(2026, 3, 30), D(2026, 3, 31), D(2026, 3, 25), D(2026, 3, 26), D(2026, 3, 27), D(2026, 3, 28),
                       D(2026, 3, 29), D(2026, 3, 30)]
    assert all(1 <= (ref - d).days <= 7 for d in got[8:])


def test_dates(spark):
    c = F.col("t")
    assert values(spark, dates.iso_date(c), ["2024-01-08T00:00:00", "2024-03-15", "pas-une-date", "", None], "t string") == [
        D(2024, 1, 8), D(2024, 3, 15), None, None, None]
    assert values(spark, dates.quote_date(c), ["03/04/2024", "2024-04-03", "3/4/2024"], "t string") == [D(2024, 4, 3), D(2024, 4, 3), None]
    assert values(spark, dates.slash_date(c), ["3/4/2024"], "t string") == [D(2024, 4, 3)]
    assert values(spark, dates.backfill_start(F.col("d"), 5), [(D(2026, 4, 4),)], "d date") == [D(2022, 1, 1)]
    with pytest.raises(ValueError):
        dates.backfill_start(F.lit(None), 0)
    assert values(spark, dates.since_date(D(2024, 2, 29)), [1], "x int") == [D(2014, 2, 28)]
    parts = spark.range(1).select(*(v.alias(k) for k, v in dates.date_parts(F.lit(D(2024, 1, 7))).items())).first()
    assert tuple(parts) == (2024, 1, 1, 7)


def test_distance(spark):
    km = geo.haversine_km(*(F.col(c) for c in "abcd"))
    points = [(48.8566, 2.3522, 48.8566, 2.3522), (48.8566, 2.3522, 45.7640, 4.8357), (47.8474, -0.9416, 47.8564, -0.9416)]
    same, far, near = values(spark, km, points, "a double, b double, c double, d double")
    assert same == 0 and 385 < far < 400 and 0.9 < near < 1.1


def test_box(spark):
    box = geo.bounding_box(F.lit(47.8474), F.lit(-0.9416), 10.0)
    got = spark.range(1).select(*(v.alias(k) for k, v in box.items())).first()
    expected = geo.bounding_box_of(47.8474, -0.9416, 10.0)
    assert all(math.isclose(a, b) for a, b in zip(got, expected))


def test_wkt(spark):
    ring = "[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]"
    shapes = [("Polygon", f"[{ring}]"), ("MultiPolygon", f"[[{ring}]]"), ("Point", "[0.0,1.0]"), (None, None)]
    got = values(spark, geo.wkt(F.col("k"), F.col("c")), shapes, "k string, c string")
    assert got == ["POLYGON((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0))", "MULTIPOLYGON(((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0)))", "", ""]


def test_inside(spark):
    square_with_hole = "[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]"
    c = geo.inside(geo.polygons(F.lit("Polygon"), F.lit(square_with_hole)), F.col("x"), F.col("y"))
    assert values(spark, c, [(3.0, 3.0), (1.5, 1.5), (5.0, 1.0), (-1.0, 2.0)], "x double, y double") == [True, False, False, False]


def test_quote_numbers_read_as_by_the_full_patterns(spark):
    """Bare numbers are read at once; every text must give what the two replacements gave."""
    texts = ["1,5", "1.5", "12", "-3,", ",5", "+,5e2", "1,2,3", "1 200,5", " 7", "7 ", "7\n", "7\n\n", "1,5\u0085", "1\u00a0200", "1 2 3", "nd", "", " ",
             ",", "12f", "0x1p3", "NaN", "1e400", "1,5 EUR", "\t4,25", "1\u2028", None]
    c = F.col("t")
    plain = text.lenient_double(F.regexp_replace(F.regexp_replace(c, r"^([^,]*),", "$1."), r"^(\S*)\s+", "$1"))
    assert values(spark, text.decimal_comma_number(c), texts, "t string") == values(spark, plain, texts, "t string")
    explained = spark.createDataFrame([("1,5",)], "t string").select(text.decimal_comma_number(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "^([^,]*)," not in explained
