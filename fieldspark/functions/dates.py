"""Date parsing and calendar classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_col, case_when


def parse_timestamp(c: ColumnLike, *formats: str) -> Column:
    """First format that reads the text; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(as_col(c), F.lit(f)) for f in formats])


def dmy(c: ColumnLike) -> Column:
    """Day-month-year text as a date."""
    text = F.regexp_replace(as_col(c), r"[./ ]", "-")
    return parse_timestamp(text, "d-M-yyyy", "d-M-yy").cast("date")


def dmy_hms(c: ColumnLike) -> Column:
    """Day-month-year text with a time; the seconds may be missing."""
    text = F.regexp_replace(as_col(c), r"[./]", "-")
    return parse_timestamp(text, "d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yy H:m:s", "d-M-yy H:m")


def mdy_hms(c: ColumnLike) -> Column:
    """Month/day/year text with a time, 12 or 24 hours."""
    text = F.regexp_replace(as_col(c), r"[./]", "-")
    return parse_timestamp(text, "M-d-yy h:m:s a", "M-d-yyyy h:m:s a", "M-d-yy H:m:s", "M-d-yyyy H:m:s", "M-d-yy H:m")


def ymd_hms(c: ColumnLike) -> Column:
    text = F.regexp_replace(as_col(c), r"[./]", "-")
    return parse_timestamp(text, "y-M-d H:m:s", "y-M-d H:m")


def days_since(c: ColumnLike, origin: str) -> Column:
    """Date from a number of days after ``origin`` (yyyy-MM-dd)."""
    return F.date_add(F.lit(origin).cast("date"), as_col(c).cast("int"))


def time_of_day(hour: ColumnLike) -> Column:
    """``day`` 10-18, ``night`` 21-6, ``spinup`` in between."""
    h = as_col(hour)
    return case_when(
        (h.between(10, 18), "day"),
        ((h >= 21) | (h <= 6), "night"),
        (h.isNotNull(), "spinup"),
    )


def season(month: ColumnLike) -> Column:
    m = as_col(month)
    return case_when(
        (m.isin(12, 1, 2), "winter"),
        (m.between(3, 5), "spring"),
        (m.between(6, 8), "summer"),
        (m.between(9, 11), "autumn"),
    )


def census_year(code: ColumnLike) -> Column:
    """Year of a census code such as ``aut_09``."""
    return F.concat(F.lit("20"), F.substring(as_col(code), 5, 2)).try_cast("int")


def census_date(code: ColumnLike) -> Column:
    """First day of the census month: April for ``spr``, September for ``aut``."""
    c = as_col(code)
    month = case_when((F.substring(c, 1, 3) == "spr", 4), (F.substring(c, 1, 3) == "aut", 9))
    return F.when(month.isNotNull() & census_year(c).isNotNull(), F.make_date(census_year(c), month, F.lit(1)))


def nominal_date(doy: ColumnLike, year: int = 2000) -> Column:
    """Day of year laid on one nominal (leap) year, for climatologies."""
    return F.date_add(F.lit(f"{year}-01-01").cast("date"), as_col(doy).cast("int") - 1)
