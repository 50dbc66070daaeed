"""Daily and month series from the gated daily table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import days_in_month, month_start
from tidemark.schemas import DAY_THRESHOLD, KEYS

AVERAGES = {"midrange": "mid", "mean": "mean"}


def average_column(average: str | Column = "midrange") -> Column:
    """Daily average: half of high plus low (default), or the mean of all values.

    A column names the method row by row, so that each station may have its own.
    """
    if isinstance(average, Column):
        return F.when(average == "mean", F.col("mean")).otherwise(F.col("mid"))
    if average not in AVERAGES:
        raise ValueError(f"average must be one of {sorted(AVERAGES)}, not {average!r}")
    return F.col(AVERAGES[average])


def _series(daily: DataFrame, gate: Column, value: Column, name: str) -> DataFrame:
    return daily.where(gate & value.isNotNull()).select(*KEYS, "date", value.alias(name))


def daily_highs(daily: DataFrame) -> DataFrame:
    """Highest value of each good day."""
    return _series(daily, F.col("good_day"), F.col("high"), "high")


def daily_lows(daily: DataFrame) -> DataFrame:
    """Lowest value of each good day."""
    return _series(daily, F.col("good_day"), F.col("low"), "low")


def daily_avgs(daily: DataFrame, average: str = "midrange") -> DataFrame:
    """Average of each good day."""
    return _series(daily, F.col("good_day"), average_column(average), "average")


def _both_gates() -> Column:
    return F.col("good_day") & F.col("good_month")


def mon_daily_highs(daily: DataFrame) -> DataFrame:
    """Highest value of each good day in a good month."""
    return _series(daily, _both_gates(), F.col("high"), "high")


def mon_daily_lows(daily: DataFrame) -> DataFrame:
    """Lowest value of each good day in a good month."""
    return _series(daily, _both_gates(), F.col("low"), "low")


def mon_daily_avgs(daily: DataFrame, average: str = "midrange") -> DataFrame:
    """Average of each good day in a good month."""
    return _series(daily, _both_gates(), average_column(average), "average")


def all_months(
    daily: DataFrame, average: str | Column = "midrange", day_threshold: int | Column = DAY_THRESHOLD
) -> DataFrame:
    """Mean, highest and lowest daily average of each month, and if it is good.

    Needs only the day gate: the month gate compares the day count that the
    same aggregate makes, so the month costs one shuffle and no window.
    `day_threshold` may be a column that is constant per station.
    """
    avg = F.when(F.col("good_day"), average_column(average))
    date = F.when(avg.isNotNull(), F.col("date"))
    threshold = F.lit(day_threshold) if isinstance(day_threshold, int) else day_threshold
    months = daily.groupBy(*KEYS, month_start("date").alias("month_start")).agg(
        F.count(avg).alias("n_days"),
        F.avg(avg).alias("mean"),
        F.max(avg).alias("high"),
        F.min(avg).alias("low"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.max(threshold).alias("threshold"),
    )
    enough = F.col("n_days") >= days_in_month("month_start") - F.col("threshold")
    return months.withColumn("enough", enough & (F.col("n_days") > 0)).drop("threshold")


def month_series(
    daily: DataFrame, average: str = "midrange", day_threshold: int | Column = DAY_THRESHOLD
) -> DataFrame:
    """Mean, highest and lowest daily average of each good month."""
    return all_months(daily, average, day_threshold).where("enough").drop("enough")


def monthly_highs(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Highest daily average of each good month."""
    return month_series(daily, average, day_threshold).select(*KEYS, "month_start", "high")


def monthly_lows(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Lowest daily average of each good month."""
    return month_series(daily, average, day_threshold).select(*KEYS, "month_start", "low")


def monthly_means(
    daily: DataFrame, average: str = "midrange", day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """Mean of the daily averages of each good month."""
    return month_series(daily, average, day_threshold).select(*KEYS, "month_start", "mean")
