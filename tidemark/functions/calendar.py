"""Column expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import _col

# A leap year, so that all 366 labels exist.
LABEL_YEAR = 2020


def is_leap(date: Column | str) -> Column:
    d = _col(date)
    return F.dayofmonth(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 29


def yearday366(date: Column | str) -> Column:
    """Day of the year on a 366-day calendar.

    Day 60 is 29 Feb and is skipped in common years, so 1 Mar is always 61 and
    31 Dec always 366.
    """
    d = _col(date)
    shift = F.when((F.month(d) > 2) & ~is_leap(d), 1).otherwise(0)
    return (F.dayofyear(d) + shift).cast("int")


def day_label(yearday: Column | str) -> Column:
    """Label of a yearday: 1 gives ``01-Jan``, 366 gives ``31-Dec``."""
    last = F.make_date(F.lit(LABEL_YEAR - 1), F.lit(12), F.lit(31))
    return F.date_format(F.date_add(last, _col(yearday)), "dd-MMM")


def month_label(month: Column | str) -> Column:
    """Label of a month number: 1 gives ``Jan``."""
    return F.date_format(F.make_date(F.lit(LABEL_YEAR), _col(month), F.lit(1)), "MMM")


def format_date(date: Column | str) -> Column:
    """``YYYYMMDD`` text of a date, a timestamp or date text."""
    return F.date_format(F.to_date(_col(date)), "yyyyMMdd")


def format_day(date: Column | str) -> Column:
    """``m/d/yyyy`` text of a date."""
    return F.date_format(_col(date), "M/d/yyyy")


def format_range(start: Column | str, end: Column | str) -> Column:
    """``m/d/yyyy - m/d/yyyy`` text of a date range."""
    return F.concat_ws(" - ", format_day(start), format_day(end))


def month_start(date: Column | str) -> Column:
    return F.trunc(_col(date), "month")


def days_in_month(date: Column | str) -> Column:
    return F.dayofmonth(F.last_day(_col(date)))


def month_number(date: Column | str) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    d = _col(date)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def month_from_number(number: Column | str) -> Column:
    """First day of the month with this number."""
    n = _col(number)
    return F.make_date(
        F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1)
    )
