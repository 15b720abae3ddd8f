"""Dates written as text in several notations, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first letters of the months' names (May has two forms).
MONTHS = {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6,
    "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

_NAMED = r"^(\p{L}{3})\p{L}*\.?\s+(\d{4})$"


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Rewrites in turn; each expression refers to its input once, so plans stay small."""
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def _blanks(text: Column) -> Column:
    return F.trim(F.translate(text, " \t\n\r", "    "))


def parse_date(text: Column) -> Column:
    """DATE of a text naming one day, else null.

    Year-first, day-first (where the year comes last the day comes first) and
    compact notations, with or without a time of day.  Days that do not exist
    give null, never an error.
    """
    written = _chain(
        _blanks(text),
        (r"[T ,].*$", ""),
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"),
        (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
        (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$", "$1-$2-$3"),
    )
    return F.try_to_date(written, "yyyy-M-d")


def month_index(text: Column, first_year: int = 2023, months: int = 24) -> Column:
    """INT number of months since January of ``first_year``, null where the text
    names no month of the window."""
    t = _blanks(text)
    names = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(f"{v:02d}"))])
    named = F.concat(
        F.regexp_extract(t, _NAMED, 2), F.lit("-"), F.try_element_at(names, F.lower(F.substring(t, 1, 3)))
    )
    written = _chain(
        t,
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[T ,].*)?$", "$3-$2"),
        (r"^(\d{1,2})[-/.](\d{4})$", "$2-$1"),
        (r"^(\d{4})(\d{2})(?:\d{2})?$", "$1-$2"),
        (r"^(\d{4})[-/.](\d{1,2})(?:[-/.]\d{1,2}(?:[T ,].*)?)?$", "$1-$2"),
        (r"^(\d{4})-(\d)$", "$1-0$2"),
    )
    plain = F.when(t.rlike(r"^\d{4}-\d{2}(?:-\d{2}(?:[T ].*)?)?$"), F.substring(t, 1, 7)).when(
        t.rlike(_NAMED), named
    ).otherwise(written)
    window = [(f"{first_year + i // 12}-{i % 12 + 1:02d}", i) for i in range(months)]
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in window for x in pair]), plain)


def month_name(index: Column, first_year: int = 2023) -> Column:
    """'YYYY-MM' of a month index."""
    year = (F.lit(first_year) + F.floor(index / 12)).cast("int").cast("string")
    return F.concat_ws("-", year, F.lpad((index % 12 + 1).cast("int").cast("string"), 2, "0"))
