"""Parcel score criteria as column expressions (0 to 100, truncated to whole points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glebe.functions.text import map_label

# band = (upper end, points at that end, width, points gained over the width), then the
# falling tail beyond the last band, given the same way with its own start.
PRICE_BANDS = [(0.9, 90, 0.1, 10), (1.0, 70, 0.1, 20), (1.2, 40, 0.2, 30)]
PRICE_TAIL = (1.2, 40, 1.0, 10)
MARKET_BANDS = [(5.0, 90, 5.0, 10), (15.0, 70, 10.0, 20), (30.0, 40, 15.0, 30)]
MARKET_TAIL = (30.0, 40, 20.0, 40)
SLOPE_BANDS = [(3.0, 90, 3.0, 10), (8.0, 70, 5.0, 20), (15.0, 40, 7.0, 30), (25.0, 15, 10.0, 25)]
SLOPE_TAIL = (25.0, 15, 10.0, 15)
ALTITUDE_BANDS = [(150.0, 85, 100.0, 10), (250.0, 70, 100.0, 15), (400.0, 50, 150.0, 20), (600.0, 20, 200.0, 30)]
ALTITUDE_TAIL = (600.0, 20, 400.0, 20)

# Points per category.
VEHICLE_POINTS = {"facile": 90, "limite": 60, "difficile": 20}
WATER_POINTS = {"reseau": 95, "riviere": 75, "forage": 80, "aucun": 5, "inconnu": 30}
ASPECT_POINTS = {
    "S": 90, "SE": 85, "SO": 85, "E": 75, "O": 75, "NE": 55, "NO": 55, "N": 35, "plat": 65,
}


def _whole(c: Column) -> Column:
    """Truncation toward zero, as a cast from double does it."""
    return c.cast("int")


def _falling(x: Column, bands: list[tuple], tail: tuple, missing: int, first_gain_cap: int | None) -> Column:
    """Points that fall band by band as ``x`` grows; never below 0 past the last band."""
    score = F.when(x.isNull(), F.lit(missing))
    for i, (upper, points, width, gain) in enumerate(bands):
        gained = (F.lit(upper) - x) / F.lit(width) * F.lit(float(gain))
        if i == 0 and first_gain_cap is not None:
            gained = F.least(F.lit(float(first_gain_cap)), gained)
        score = score.when(x <= F.lit(upper), _whole(F.lit(float(points)) + gained))
    start, points, width, loss = tail
    lost = (x - F.lit(start)) / F.lit(width) * F.lit(float(loss))
    return score.otherwise(F.greatest(F.lit(0), _whole(F.lit(float(points)) - lost)))


def price_score(asked: Column, comparable: Column, clamp: bool = False) -> Column:
    """Asked price against the comparable one.

    Missing or zero comparable price gives 50. A very low price scores above 100 unless ``clamp``.
    """
    ratio = F.try_divide(asked.cast("double"), comparable.cast("double"))
    score = _falling(ratio, PRICE_BANDS, PRICE_TAIL, missing=50, first_gain_cap=None)
    return F.least(F.lit(100), score) if clamp else score


def market_distance_score(km: Column) -> Column:
    return _falling(km.cast("double"), MARKET_BANDS, MARKET_TAIL, missing=50, first_gain_cap=10)


def vehicle_access_score(access: Column) -> Column:
    return map_label(access, VEHICLE_POINTS, 50)


def water_access_score(access: Column) -> Column:
    return map_label(access, WATER_POINTS, 30)


def flow_adjustment(flow: Column, access: Column) -> Column:
    """Points taken from water access for a weak borehole; only boreholes are adjusted."""
    borehole = (access == "forage") & flow.isNotNull()
    return F.when(borehole & (flow < 1), -30).when(borehole & (flow < 2), -10).otherwise(0)


def rain_score(mm: Column) -> Column:
    """Annual rain; flat or rising away from the middle inside the good bands.

    Fixed values: the millimetres and points of the bands.
    """
    p = mm.cast("double")
    near_middle = F.least(F.lit(5.0), F.abs(F.lit(500.0) - p) / 100)
    to_edge = F.least(F.abs(F.lit(300.0) - p), F.abs(F.lit(700.0) - p)) / 150
    return (
        F.when(p.isNull(), F.lit(50))
        .when(p.between(400.0, 600.0), _whole(F.lit(85.0) + near_middle))
        .when(p.between(300.0, 700.0), _whole(F.lit(70.0) + to_edge))
        .when((p >= 200.0) & (p < 300.0), _whole(F.lit(50.0) + (p - 200.0) / 100 * 20))
        .when((p > 700.0) & (p <= 900.0), _whole(F.lit(50.0) + (F.lit(900.0) - p) / 200 * 20))
        .otherwise(F.greatest(F.lit(20), _whole(F.least(F.lit(50.0), p / 10))))
    )


def slope_score(pct: Column) -> Column:
    return _falling(pct.cast("double"), SLOPE_BANDS, SLOPE_TAIL, missing=50, first_gain_cap=10)


def aspect_score(aspect: Column) -> Column:
    return map_label(aspect, ASPECT_POINTS, 50)


def frost_score(flag: Column, days: Column) -> Column:
    """Frost days decide when known, else the declared flag, else 70.

    Fixed values: the days and points of the bands.
    """
    d = days.cast("double")
    return (
        F.when(d < 5, _whole(F.lit(75.0) + F.least(F.lit(5.0), (F.lit(5.0) - d) / 5 * 5)))
        .when(d <= 10, _whole(F.lit(50.0) + (F.lit(10.0) - d) / 5 * 20))
        .when(d.isNotNull(), F.greatest(F.lit(20), _whole(F.lit(50.0) - (d - 10.0) / 10 * 30)))
        .when(flag.isNull(), F.lit(70))
        .when(flag, F.lit(40))
        .otherwise(F.lit(80))
    )


def altitude_score(m: Column) -> Column:
    return _falling(m.cast("double"), ALTITUDE_BANDS, ALTITUDE_TAIL, missing=65, first_gain_cap=10)


def mention(score: Column) -> Column:
    """Verdict of a score: 70 and above, 45 and above, below."""
    return F.when(score >= 70, "Favorable").when(score >= 45, "Mitigé").otherwise("Défavorable")


def recommended(score: Column) -> Column:
    return score >= 70
