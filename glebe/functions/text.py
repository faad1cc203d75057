"""Lenient text-to-value columns and label helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java number parsing also takes suffixes such as "12f"; only plain decimals are numbers here.
_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_BARE_NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_THOUSANDS = r"^\d{1,3}(,\d{3})+$"


def null_if_token(c: Column, tokens: Iterable[str]) -> Column:
    """Null where the trimmed text is one of the tokens that stand for a missing value."""
    return F.when(F.trim(c).isin(*tokens), None).otherwise(c)


def lenient_double(c: Column) -> Column:
    """Text to double; anything but a plain decimal number gives null."""
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))


def lenient_int(c: Column) -> Column:
    """Text to int; "3.7" and other non-integers give null."""
    return c.try_cast("int")


def lenient_long(c: Column) -> Column:
    return c.try_cast("bigint")


def decimal_comma_number(c: Column) -> Column:
    """Quote policy: the first comma is the decimal mark, the first run of blanks is dropped."""
    dotted = F.when(F.contains(c, F.lit(",")), F.overlay(c, F.lit("."), F.instr(c, ","), F.lit(1))).otherwise(c)
    # Most cells hold a number and nothing else; only others are searched for blanks.
    return F.when(dotted.rlike(_BARE_NUMBER), dotted.try_cast("double")).otherwise(
        lenient_double(F.regexp_replace(dotted, r"^(\S*)\s+", "$1")))


def french_number(c: Column) -> Column:
    """Sales policy: "125,000" and "1,234,567" are thousands, any other comma is a decimal mark."""
    compact = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    mark = F.when(compact.rlike(_THOUSANDS), F.lit("")).otherwise(F.lit("."))
    return lenient_double(F.replace(compact, F.lit(","), mark))


def first_non_empty(*columns: Column) -> Column:
    """First value that is neither null nor the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def first_item(c: Column) -> Column:
    """First element of a list; null for an empty or missing list."""
    return F.get(c, F.lit(0))


def map_label(c: Column, labels: Mapping, default) -> Column:
    """Fixed lookup with a default for unknown or missing codes."""
    entries = [F.lit(part) for pair in labels.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), c), F.lit(default))


def short_label(c: Column, max_len: int = 40) -> Column:
    """Text cut after ``max_len`` characters, marked with an ellipsis."""
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, max_len), F.lit("…"))).otherwise(c)


def first_word(c: Column) -> Column:
    """Product family: the text before the first blank."""
    return F.substring_index(c, " ", 1)


def clean_department(c: Column) -> Column:
    """Department code without blanks and leading zeros ("072" = "72"; "10" stays "10")."""
    return F.ltrim(F.trim(c.cast("string")), F.lit("0"))


# The accepted forms of a year, a short year and a quarter in file names, as patterns.
YEAR_FORM = r"(?<![0-9])20[0-9]{2}(?![0-9])"
SHORT_YEAR_FORM = r"(?i)A([0-9]{2})(?![0-9])"
QUARTER_FORMS = (r"[Tt]([1-4])", r"[Qq]([1-4])", r"([1-4])[eè]me trimestre", r"([1-4])er trimestre")


def year_in_text(c: Column) -> Column:
    """A year 20xx that stands alone among digits, else null."""
    return F.regexp_substr(c, F.lit(YEAR_FORM)).try_cast("int")


def quote_file_year(c: Column) -> Column:
    """Year of a quote file: 20xx in the name, else the short form "A24" = 2024."""
    short = F.nullif(F.regexp_extract(c, SHORT_YEAR_FORM, 1), F.lit(""))
    return F.coalesce(year_in_text(c), F.lit(2000) + short.try_cast("int"))


def quarter_in_text(c: Column) -> Column:
    """Quarter named as T2, Q2, "2ème trimestre" or "1er trimestre"; the first form found wins."""
    found = [F.nullif(F.regexp_extract(c, form, 1), F.lit("")).try_cast("int") for form in QUARTER_FORMS]
    return F.coalesce(*found)


def count_of(c: Column, char: str) -> Column:
    """How often a character occurs in a text."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))
