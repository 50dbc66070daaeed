"""Day-of-year and month-of-year statistics over the whole record.

All statistics of a table come out of one aggregate. An extreme and its year
travel in one struct, so ties go to the earliest year:

* highest: ``max(struct(value, -year))``
* lowest:  ``min(struct(value, year))``

A missing value makes the struct NULL, and NULL structs take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_label, month_label, yearday366
from tidemark.operators.daily import all_months, average_column, month_series
from tidemark.operators.spine import densify
from tidemark.schemas import DAILY_STATS, DAY_THRESHOLD, KEYS, MONTHLY_STATS


# What each kind of statistic makes of a column, and what it publishes.
_AGGREGATE = {
    "avg": "avg({v})",
    "max": "max(CASE WHEN {v} IS NOT NULL THEN struct({v} AS value, -year AS year) END)",
    "min": "min(CASE WHEN {v} IS NOT NULL THEN struct({v} AS value, year AS year) END)",
    # One input row per year, so counting values counts years.
    "years": "count({v})",
}
_PUBLISH = {
    "avg": ["{n}"],
    "max": ["{n}.value AS {n}", "CAST(-{n}.year AS INT) AS {n}_year"],
    "min": ["{n}.value AS {n}", "CAST({n}.year AS INT) AS {n}_year"],
    "years": ["CAST(nullif({n}, 0) AS INT) AS {n}"],
}

Stat = tuple[str, str, str]


def _aggregate(df: DataFrame, keys: list[str], stats: list[Stat]) -> DataFrame:
    """One aggregate for any set of statistics (name, kind, column).

    `df` has one row per key and year, with the year in `year`.
    """
    grouped = df.groupBy(*keys).agg(
        *[F.expr(_AGGREGATE[kind].format(v=column)).alias(name) for name, kind, column in stats]
    )
    published = [p.format(n=name) for name, kind, _ in stats for p in _PUBLISH[kind]]
    return grouped.selectExpr(*keys, *published)


# --- by day of year ---------------------------------------------------------


def _days(daily: DataFrame, average: str | Column = "midrange") -> DataFrame:
    """Daily values with their place in the calendar; bad days are NULL."""
    good = F.col("good_day")
    return daily.select(
        *KEYS,
        yearday366("date").alias("yearday"),
        F.year("date").alias("year"),
        F.when(good, average_column(average)).alias("average"),
        F.when(good, F.col("high")).alias("high"),
        F.when(good, F.col("low")).alias("low"),
    )


def _by_day(daily: DataFrame, stat: Stat, average: str = "midrange") -> DataFrame:
    """One statistic over the good days."""
    days = _days(_good_days(daily), average)
    return _aggregate(days, [*KEYS, "yearday"], [stat])


def _good_days(daily: DataFrame) -> DataFrame:
    return daily.where(F.col("good_day") & F.col("high").isNotNull())


def daily_avg(daily: DataFrame, average: str = "midrange") -> DataFrame:
    """Mean of the daily averages of each day of the year."""
    return _by_day(daily, ("daily_average", "avg", "average"), average)


def record_high_daily_avg(daily: DataFrame, average: str = "midrange") -> DataFrame:
    """Highest daily average and its year."""
    return _by_day(daily, ("record_high_daily_average", "max", "average"), average)


def record_low_daily_avg(daily: DataFrame, average: str = "midrange") -> DataFrame:
    """Lowest daily average and its year."""
    return _by_day(daily, ("record_low_daily_average", "min", "average"), average)


def avg_daily_high(daily: DataFrame) -> DataFrame:
    """Mean of the daily highs."""
    return _by_day(daily, ("average_high", "avg", "high"))


def lowest_daily_high(daily: DataFrame) -> DataFrame:
    """Lowest daily high and its year."""
    return _by_day(daily, ("lowest_high", "min", "high"))


def record_daily_high(daily: DataFrame) -> DataFrame:
    """Highest daily high and its year."""
    return _by_day(daily, ("record_high", "max", "high"))


def avg_daily_low(daily: DataFrame) -> DataFrame:
    """Mean of the daily lows."""
    return _by_day(daily, ("average_low", "avg", "low"))


def highest_daily_low(daily: DataFrame) -> DataFrame:
    """Highest daily low and its year."""
    return _by_day(daily, ("highest_low", "max", "low"))


def record_daily_low(daily: DataFrame) -> DataFrame:
    """Lowest daily low and its year."""
    return _by_day(daily, ("record_low", "min", "low"))


def number_of_years_byday(daily: DataFrame) -> DataFrame:
    """Years with data for each day of the year."""
    return _by_day(daily, ("years", "years", "high"))


# --- by month of year -------------------------------------------------------


def _over_months(months: DataFrame, stats: list[Stat]) -> DataFrame:
    dated = months.withColumns({"month": F.month("month_start"), "year": F.year("month_start")})
    return _aggregate(dated, [*KEYS, "month"], stats)


def _by_month(daily: DataFrame, average: str, day_threshold: int | Column, stat: Stat) -> DataFrame:
    """One statistic over the good months."""
    return _over_months(month_series(daily, average, day_threshold), [stat])


def monthly_avg(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Mean over the years of the monthly means."""
    return _by_month(daily, average, day_threshold, ("monthly_average", "avg", "mean"))


def record_high_monthly_avg(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Highest monthly mean and its year."""
    return _by_month(
        daily, average, day_threshold, ("record_high_monthly_average", "max", "mean")
    )


def record_low_monthly_avg(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Lowest monthly mean and its year."""
    return _by_month(
        daily, average, day_threshold, ("record_low_monthly_average", "min", "mean")
    )


def avg_monthly_high(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Mean of the monthly highs."""
    return _by_month(daily, average, day_threshold, ("average_high", "avg", "high"))


def lowest_monthly_high(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Lowest monthly high and its year."""
    return _by_month(daily, average, day_threshold, ("lowest_high", "min", "high"))


def record_monthly_high(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Highest monthly high and its year."""
    return _by_month(daily, average, day_threshold, ("record_high", "max", "high"))


def avg_monthly_low(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Mean of the monthly lows."""
    return _by_month(daily, average, day_threshold, ("average_low", "avg", "low"))


def highest_monthly_low(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Highest monthly low and its year."""
    return _by_month(daily, average, day_threshold, ("highest_low", "max", "low"))


def record_monthly_low(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Lowest monthly low and its year."""
    return _by_month(daily, average, day_threshold, ("record_low", "min", "low"))


def number_of_years_bymonth(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Years with a good month for each month of the year."""
    return _by_month(daily, average, day_threshold, ("years", "years", "mean"))


# --- published tables -------------------------------------------------------

_HIGHS_AND_LOWS = [
    ("average_high", "avg", "high"),
    ("lowest_high", "min", "high"),
    ("record_high", "max", "high"),
    ("average_low", "avg", "low"),
    ("highest_low", "max", "low"),
    ("record_low", "min", "low"),
    ("years", "years", "high"),
]
_DAILY = [
    ("daily_average", "avg", "average"),
    ("record_high_daily_average", "max", "average"),
    ("record_low_daily_average", "min", "average"),
    *_HIGHS_AND_LOWS,
]
_MONTHLY = [
    ("monthly_average", "avg", "mean"),
    ("record_high_monthly_average", "max", "mean"),
    ("record_low_monthly_average", "min", "mean"),
    *_HIGHS_AND_LOWS,
]


def daily_labels(daily: DataFrame, average: str | Column = "midrange") -> DataFrame:
    """The daily statistics of the days of the year that occur in `daily`.

    Bad days count for nothing but stay in, so that a series without any good
    day has its labels too, with NULL throughout.
    """
    return _aggregate(_days(daily, average), [*KEYS, "yearday"], _DAILY)


def publish_daily(labels: DataFrame) -> DataFrame:
    """Daily statistics on 366 labelled days of each series; absent days are NULL."""
    labelled = densify(labels.select(*KEYS, "yearday", *DAILY_STATS), KEYS, "yearday", 1, 366)
    return labelled.select(
        *KEYS, "yearday", day_label("yearday").alias("date_label"), *DAILY_STATS
    )


def daily_stats(daily: DataFrame, average: str | Column = "midrange") -> DataFrame:
    """All daily statistics on 366 labelled days; days without data are NULL.

    A series without any good day is published as well, with NULL throughout.
    """
    return publish_daily(daily_labels(daily, average))


def monthly_labels(months: DataFrame) -> DataFrame:
    """The monthly statistics of the months of the year that occur in `all_months`."""
    masked = {c: F.when(F.col("enough"), F.col(c)) for c in ("mean", "high", "low")}
    return _over_months(months.withColumns(masked), _MONTHLY)


def publish_monthly(labels: DataFrame) -> DataFrame:
    """Monthly statistics on 12 labelled months of each series; absent months are NULL."""
    labelled = densify(labels.select(*KEYS, "month", *MONTHLY_STATS), KEYS, "month", 1, 12)
    return labelled.select(
        *KEYS, "month", month_label("month").alias("month_label"), *MONTHLY_STATS
    )


def monthly_stats(
    daily: DataFrame,
    average: str | Column = "midrange",
    day_threshold: int | Column = DAY_THRESHOLD,
) -> DataFrame:
    """All monthly statistics on 12 labelled months; months without data are NULL.

    A series without any good month is published as well, with NULL throughout.
    """
    return publish_monthly(monthly_labels(all_months(daily, average, day_threshold)))


def data_range(
    daily: DataFrame, kind: str = "daily", day_threshold: int | Column = DAY_THRESHOLD
) -> DataFrame:
    """First and last valid date of each variable after the day or month gate."""
    if kind == "daily":
        return (
            _good_days(daily)
            .groupBy(*KEYS)
            .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
        )
    if kind == "monthly":
        return range_of_months(month_series(daily, day_threshold=day_threshold))
    raise ValueError(f"kind must be 'daily' or 'monthly', not {kind!r}")


def range_of_months(months: DataFrame) -> DataFrame:
    """First and last valid date of each variable from its good months."""
    return months.groupBy(*KEYS).agg(
        F.min("first_date").alias("start_date"), F.max("last_date").alias("end_date")
    )
