"""Statistics brought up to date from the days that changed.

A statistic of a label (a day or month of the year) depends on one state per
year: the daily summary, or the month made of the daily summaries. Only labels
with a changed state are aggregated again, over all their years, so a value
that went away is retracted as easily as one that came. Everything else is
taken over from the old table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_start, yearday366
from tidemark.operators.daily import all_months
from tidemark.operators.normals import (
    daily_labels,
    data_range,
    monthly_labels,
    publish_daily,
    publish_monthly,
    range_of_months,
)
from tidemark.schemas import DAILY_STATS, KEYS, MONTHLY_STATS, MONTHS


def touched_labels(changed: DataFrame, kind: str) -> DataFrame:
    """Days or months of the year that the changed days fall on."""
    axis = yearday366("date").alias("yearday") if kind == "daily" else F.month("date").alias("month")
    return changed.select(*KEYS, axis).distinct()


def restate_daily(
    old: DataFrame, gated: DataFrame, changed: DataFrame | None, average: str | Column
) -> DataFrame:
    """`daily_stats` of the series in `gated`, from the old table and the changed days.

    `gated` are all years of these series with `good_day`; `changed` are rows of
    (station_id, variable, date), or None to aggregate every label.
    """
    if changed is None:
        return publish_daily(daily_labels(gated, average))
    labels = touched_labels(changed, "daily")
    on = [*KEYS, "yearday"]
    days = gated.withColumn("yearday", yearday366("date")).join(labels, on, "left_semi")
    kept = old.join(labels, on, "left_anti").select(*on, *DAILY_STATS)
    return publish_daily(kept.unionByName(daily_labels(days, average).select(*on, *DAILY_STATS)))


def restate_months(
    old: DataFrame,
    gated: DataFrame,
    changed: DataFrame | None,
    average: str | Column,
    day_threshold: int | Column,
) -> DataFrame:
    """`all_months` of the series in `gated`, from the old months and the changed days."""
    if changed is None:
        return all_months(gated, average, day_threshold).select(*MONTHS.fieldNames())
    on = [*KEYS, "month_start"]
    touched = changed.select(*KEYS, month_start("date").alias("month_start")).distinct()
    days = gated.withColumn("month_start", month_start("date")).join(touched, on, "left_semi")
    fresh = all_months(days.drop("month_start"), average, day_threshold)
    kept = old.join(touched, on, "left_anti")
    return kept.select(*MONTHS.fieldNames()).unionByName(fresh.select(*MONTHS.fieldNames()))


def restate_monthly(old: DataFrame, months: DataFrame, changed: DataFrame | None) -> DataFrame:
    """`monthly_stats` from the old table, the months and the changed days."""
    if changed is None:
        return publish_monthly(monthly_labels(months))
    labels = touched_labels(changed, "monthly")
    on = [*KEYS, "month"]
    dated = months.withColumn("month", F.month("month_start")).join(labels, on, "left_semi")
    kept = old.join(labels, on, "left_anti").select(*on, *MONTHLY_STATS)
    fresh = monthly_labels(dated.drop("month")).select(*on, *MONTHLY_STATS)
    return publish_monthly(kept.unionByName(fresh))


def restate_ranges(gated: DataFrame, months: DataFrame, units: DataFrame) -> DataFrame:
    """Data range of both kinds with the unit: station, variable, kind, bounds, unit."""
    days = data_range(gated, "daily").withColumn("kind", F.lit("daily"))
    good = range_of_months(months.where("enough")).withColumn("kind", F.lit("monthly"))
    return days.unionByName(good).join(units, KEYS, "left").select(*KEYS, "kind", "start_date", "end_date", "unit")
