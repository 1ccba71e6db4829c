"""Column casts of extracted text: decimal, date."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number once the decimal comma is a point. Needed because Spark also reads
# type suffixes and hexadecimal floats, which must become NULL.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"

# Range of a nanosecond timestamp; dates outside it become NULL.
_FIRST_DATE = "1677-09-22"
_LAST_DATE = "2262-04-11"

_THREE_PARTS = r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})(?:[ T]\d{1,2}:\d{2}.*)?$"


def decimal_point(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("."))


def to_double(text: Column) -> Column:
    """Number with decimal comma or point; NULL when the text is not a number."""
    pointed = decimal_point(text)
    return F.when(pointed.rlike(_NUMBER), F.trim(pointed).try_cast("double"))


def current_year() -> int:
    return datetime.now(timezone.utc).year


def _full_year(year: Column, reference_year: int) -> Column:
    """Two digits become the year within fifty years of the reference year."""
    century = reference_year // 100 * 100
    number = year.try_cast("int")
    guess = century + number
    near = (
        F.when(guess >= reference_year + 50, guess - 100)
        .when(guess < reference_year - 50, guess + 100)
        .otherwise(guess)
    )
    return F.when(F.length(year) == 4, number).when(F.length(year) <= 2, near)


def _assembled(year: Column, month: Column, day: Column) -> Column:
    padded = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day)
    return F.when(year.isNotNull(), padded.try_cast("date"))


def date_parts(text: Column) -> Column:
    """The three numbers of a date as an array, empty strings when it is none."""
    trimmed = F.trim(text)
    return F.array(*[F.regexp_extract(trimmed, _THREE_PARTS, i) for i in (1, 2, 3)])


def date_from_parts(parts: Column, reference_year: int, mode: str = "compat") -> Column:
    """Date from three numbers, day first where the text leaves a choice.

    ``compat``: the year is the part with four digits, or the first part when it is above 31,
    or else the last part. Of the other two the earlier one is the day; if that is no date,
    they change places. So ``2024-05-01`` is the 5th of January.
    ``iso``: a leading year is followed by month and day; the rest as above.
    """
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    number = first.try_cast("int")
    year_first = (F.length(first) == 4) | ((F.length(first) <= 2) & (number > 31))
    year = _full_year(F.when(year_first, first).otherwise(third), reference_year)
    fits = F.when(year_first, F.length(third) <= 2).otherwise(F.length(first) <= 2)
    early = F.when(year_first, second).otherwise(first)
    late = F.when(year_first, third).otherwise(second)
    day_first = _assembled(year, late, early)
    month_first = _assembled(year, early, late)
    if mode == "iso":
        found = F.when(year_first, month_first).otherwise(F.coalesce(day_first, month_first))
    else:
        found = F.coalesce(day_first, month_first)
    in_range = found.between(F.lit(_FIRST_DATE).cast("date"), F.lit(_LAST_DATE).cast("date"))
    return F.when(fits & in_range, found)


def to_date(text: Column, reference_year: int, mode: str = "compat") -> Column:
    """Day-first date; NULL when the text is not a date. The time of day is dropped."""
    if mode not in ("compat", "iso"):
        raise ValueError(f"unknown date mode {mode!r}")
    return date_from_parts(date_parts(text), reference_year, mode)
