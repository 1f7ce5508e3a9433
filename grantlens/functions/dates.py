"""Date expressions for day-first and year-first text dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from grantlens.functions.names import title_name
from grantlens.functions.text import blank_to_null

DAY_FIRST = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"
YEAR_FIRST = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"
# Names of months; the first three letters are known too.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: A month as a word: full names first, then the short ones.
MONTH_WORD = r"\b(" + "|".join([*MONTHS, *(m[:3].upper() for m in MONTHS)]) + r")\b"
DAYS_PER_MONTH_FRESHNESS = 30.0
DAYS_PER_MONTH_EXPIRY = 30.44


def parse_date(text: Column, first_year: int = 1900, last_year: int = 2100) -> Column:
    """The calendar date, NULL when the text is no date, impossible or out of range.

    Free-form text is never guessed: only the two numeric layouts count.
    """
    dashed = F.regexp_replace(F.trim(text), "[/.]", "-")
    parsed = (
        F.when(F.trim(text).rlike(DAY_FIRST), F.try_to_date(dashed, "d-M-yyyy"))
        .when(F.trim(text).rlike(YEAR_FIRST), F.try_to_date(dashed, "yyyy-M-d"))
    )
    return F.when(F.year(parsed).between(first_year, last_year), parsed)


def display_date(text: Column) -> Column:
    """DD-MM-YYYY, or the text unchanged when it is no date."""
    return F.coalesce(F.date_format(parse_date(text), "dd-MM-yyyy"), text)


def dashed_date(text: Column) -> Column:
    """Only the separators unified: two layouts of one day still differ."""
    return F.trim(F.translate(text, "./", "--"))


def months_between_days(later: Column, earlier: Column, days_per_month: float) -> Column:
    return F.datediff(later, earlier) / F.lit(days_per_month)


def normalize_month(text: Column) -> Column:
    """The full name of a month given whole or by three letters, in any case; other words in title case, NULL for none."""
    key = F.lower(F.trim(text))
    out = None
    for name in MONTHS:
        test = key.isin(name.lower(), name[:3].lower())
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(blank_to_null(title_name(text)))
