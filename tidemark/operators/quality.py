"""Quality gates: which days and months hold enough data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import days_in_month, month_start
from tidemark.functions.scalars import nan_to_null, null_fill_value
from tidemark.schemas import DAY_THRESHOLD, FILL_VALUE, HR_THRESHOLD, KEYS

_DAY = [*KEYS, "date"]


def clean_value(
    fill_value: float | None = FILL_VALUE, fill_variables: list[str] | None = None
) -> Column:
    """`value` with NaN and the fill value as NULL."""
    value = nan_to_null("value")
    if fill_value is None:
        return value
    return null_fill_value(value, fill_value, "variable", fill_variables)


def daily_summary(
    obs: DataFrame,
    fill_value: float | None = FILL_VALUE,
    fill_variables: list[str] | None = None,
) -> DataFrame:
    """One row per station, variable and day: the only pass over observations.

    Every aggregate combines on the map side into fixed-width buffers, so the
    shuffle carries days, not readings, and a hot station only adds map work.
    Hours with data are the set bits of a 24-bit mask. `preliminary` tells
    whether the day still holds unverified readings, `last_obs` the time of its
    last reading, fill values included; with these two, no later step has to
    look at the observations again.
    """
    readings = obs.select(
        *KEYS,
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        clean_value(fill_value, fill_variables).alias("value"),
        F.coalesce(F.col("qc") == "p", F.lit(False)).alias("preliminary"),
        F.when(nan_to_null("value").isNotNull(), F.col("ts")).alias("observed"),
    )
    hour_bit = F.when(F.col("value").isNotNull(), F.expr("shiftleft(1, hour)"))
    return (
        readings.groupBy(*_DAY)
        .agg(
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.avg("value").alias("mean"),
            F.bit_or(hour_bit).alias("hours"),
            F.bool_or("preliminary").alias("preliminary"),
            F.max("observed").alias("last_obs"),
        )
        .select(
            *_DAY,
            "high",
            "low",
            "mean",
            ((F.col("high") + F.col("low")) / 2).alias("mid"),
            F.coalesce(F.bit_count("hours"), F.lit(0)).cast("int").alias("n_hours"),
            "preliminary",
            "last_obs",
        )
    )


def is_good_day(hr_threshold: int | Column = HR_THRESHOLD) -> Column:
    """At most `hr_threshold` hours of the day are without data."""
    return F.col("n_hours") >= 24 - hr_threshold


def good_day(daily: DataFrame, hr_threshold: int | Column = HR_THRESHOLD) -> DataFrame:
    """Mark the days that hold enough hours."""
    return daily.withColumn("good_day", is_good_day(hr_threshold))


def good_month(daily: DataFrame, day_threshold: int = DAY_THRESHOLD) -> DataFrame:
    """Mark the days of months that hold enough good days.

    A month counts the days that passed the day gate and have data. The window
    group is one month of one series: at most 31 rows.
    """
    month = Window.partitionBy(*KEYS, month_start("date"))
    n_days = F.count_if(F.col("good_day") & F.col("high").isNotNull()).over(month)
    return daily.withColumn("good_month", n_days >= days_in_month("date") - day_threshold)


def daily_table(
    obs: DataFrame,
    hr_threshold: int = HR_THRESHOLD,
    day_threshold: int = DAY_THRESHOLD,
    fill_value: float | None = FILL_VALUE,
    fill_variables: list[str] | None = None,
) -> DataFrame:
    """Daily summaries with both gates marked."""
    return apply_gates(
        daily_summary(obs, fill_value, fill_variables), hr_threshold, day_threshold
    )


def apply_gates(
    daily: DataFrame, hr_threshold: int = HR_THRESHOLD, day_threshold: int = DAY_THRESHOLD
) -> DataFrame:
    """(Re)mark both gates on stored daily summaries; observations are not read."""
    return good_month(good_day(daily, hr_threshold), day_threshold)


def _drop_days(obs: DataFrame, good: DataFrame, fill_value, fill_variables) -> DataFrame:
    """Observations on the listed days, joined by series and day."""
    dated = obs.withColumn("date", F.to_date("ts"))
    dated = dated.withColumn("value", clean_value(fill_value, fill_variables))
    return dated.join(good.select(*_DAY), _DAY, "left_semi").select(*obs.columns)


def _gated(obs: DataFrame, hr_threshold: int, fill_value, fill_variables) -> DataFrame:
    """Observations with the hours of their day that hold data, `good_day` and `month`.

    One window over each day of a series. It is part of a month, so readings
    that lie bucketed by series and month (`write_bucketed`) are neither
    shuffled here nor for the month gate.
    """
    month = F.col("month") if "month" in obs.columns else month_start(F.to_date("ts"))
    rows = obs.withColumns(
        {"month": month, "date": F.to_date("ts"), "value": clean_value(fill_value, fill_variables)}
    )
    bit = F.when(F.col("value").isNotNull(), F.expr("shiftleft(1, hour(ts))"))
    day = Window.partitionBy(*KEYS, "month", "date")
    hours = F.coalesce(F.bit_count(F.bit_or(bit).over(day)), F.lit(0)).cast("int")
    return rows.withColumn("n_hours", hours).withColumn("good_day", is_good_day(hr_threshold))


def filter_days_by_hours(
    obs: DataFrame,
    hr_threshold: int = HR_THRESHOLD,
    fill_value: float | None = FILL_VALUE,
    fill_variables: list[str] | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Observations of good days; fill values come back as NULL.

    Reads the observations once and starts no job. With the stored `daily`
    summaries of the same observations, which are far smaller, the days are
    joined; without, they are a window over the readings, which costs no
    exchange if these are bucketed.
    """
    if daily is not None:
        good = daily.where(is_good_day(hr_threshold))
        return _drop_days(obs, good, fill_value, fill_variables)
    return _gated(obs, hr_threshold, fill_value, fill_variables).where("good_day").select(*obs.columns)


def filter_months_by_days(
    obs: DataFrame,
    hr_threshold: int = HR_THRESHOLD,
    day_threshold: int = DAY_THRESHOLD,
    fill_value: float | None = FILL_VALUE,
    fill_variables: list[str] | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Observations of good days in good months; fill values come back as NULL.

    See `filter_days_by_hours`. Good days are the set bits of a 31-bit mask.
    """
    if daily is not None:
        good = apply_gates(daily, hr_threshold, day_threshold).where("good_day AND good_month")
        return _drop_days(obs, good, fill_value, fill_variables)
    rows = _gated(obs, hr_threshold, fill_value, fill_variables)
    bit = F.when(F.col("good_day") & (F.col("n_hours") > 0), F.expr("shiftleft(1L, day(date))"))
    n_days = F.coalesce(F.bit_count(F.bit_or(bit).over(Window.partitionBy(*KEYS, "month"))), F.lit(0))
    enough = n_days >= days_in_month("month") - day_threshold
    return rows.withColumn("good_month", enough).where("good_day AND good_month").select(*obs.columns)
