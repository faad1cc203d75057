"""Lenient dates, date parts and work-duration texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from glebe.functions.numbers import rounded
from glebe.schemas import WEEKDAYS


def iso_date(c: Column) -> Column:
    """Date of an ISO text with optional time; bad text gives null."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def slash_date(c: Column) -> Column:
    """Day/month/year; one-digit days and months are accepted, bad text gives null."""
    return F.try_to_date(c, "d/M/yyyy")


def quote_date(c: Column) -> Column:
    """Date of a quote: dd/mm/yyyy when the text has exactly that shape, else ISO."""
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), slash_date(c)).otherwise(F.try_to_date(c, "yyyy-MM-dd"))


def date_parts(c: Column) -> dict[str, Column]:
    """Year, month, ISO week and weekday (1 = Monday ... 7 = Sunday)."""
    return {
        "annee": F.year(c),
        "mois": F.month(c),
        "semaine": F.weekofyear(c),
        "jour_semaine": F.weekday(c) + 1,
    }


def period_start(c: Column, every: str) -> Column:
    """First day of the week (Monday) or month that holds the date."""
    if every not in ("week", "month"):
        raise ValueError(f"period must be 'week' or 'month', not {every!r}")
    return F.trunc(c, every)


def backfill_start(end: Column, years: int) -> Column:
    """1 January of the first of ``years`` calendar years ending in the year of ``end``."""
    if years < 1:
        raise ValueError("a backfill covers at least one year")
    return F.make_date(F.year(end) - (years - 1), F.lit(1), F.lit(1))


def since_date(until: dt.date, since_year: int | None = None, years: int = 10) -> Column:
    """Start of a measurement window: a given year, or ``years`` back (29 February is safe)."""
    if since_year:
        return F.make_date(F.lit(since_year), F.lit(1), F.lit(1))
    return F.add_months(F.lit(until), -12 * years)


# The accepted forms of a duration, as patterns.
HOURS_MINUTES_FORM = r"^(\d+)h(\d+)m?$"
HOURS_FORM = r"^(\d+(?:\.\d+)?)h$"
MINUTES_FORM = r"^(\d+)(?:min|m)$"


def duration_hours(c: Column) -> Column:
    """Hours from "2h30", "2h30m", "1.5h", "90min" or "90m"; any other text gives null."""
    t = F.lower(F.trim(c))

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("double")

    return F.coalesce(
        part(HOURS_MINUTES_FORM, 1) + part(HOURS_MINUTES_FORM, 2) / 60,
        part(HOURS_FORM, 1),
        part(MINUTES_FORM, 1) / 60,
    )


def relative_date(c: Column, ref: Column) -> Column:
    """Date from a day word, a weekday name (always 1 to 7 days back), ISO or day/month/year."""
    t = F.lower(F.trim(c))
    weekday = F.try_element_at(F.create_map(*(F.lit(x) for kv in WEEKDAYS.items() for x in kv)), t)
    back = F.pmod(F.weekday(ref) - weekday, F.lit(7))
    return F.coalesce(
        F.when(t.isin("aujourd'hui", "auj", "today"), ref),
        F.when(t == "hier", F.date_sub(ref, 1)),
        F.when(weekday.isNotNull(), F.date_sub(ref, F.when(back == 0, 7).otherwise(back))),
        F.try_to_date(c, "yyyy-MM-dd"),
        slash_date(c),
    )


def hours_between(start: Column, stop: Column) -> Column:
    """Hours between two timestamps, two decimals."""
    return rounded(F.timestamp_diff("SECOND", start, stop) / F.lit(3600.0), 2)
