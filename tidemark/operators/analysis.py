"""Counting records by year and looking values up for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import format_range
from tidemark.functions.scalars import round_down, round_half_even, round_stat, round_up
from tidemark.operators.spine import densify
from tidemark.schemas import (
    KEYS,
    VARIABLE,
    axis_column,
    label_column,
    record_names,
)


def _counts_by_year(stats: DataFrame) -> DataFrame:
    names = record_names(stats.columns)
    records = ", ".join(f"struct('{n}' AS record, {n}_year AS year)" for n in names)
    rows = stats.selectExpr(*KEYS, f"inline(array({records}))").where("year IS NOT NULL")
    return rows.groupBy(*KEYS, "year").agg(
        *[F.expr(f"CAST(count_if(record = '{n}') AS INT)").alias(n) for n in names]
    )


def record_counts(stats: DataFrame) -> DataFrame:
    """How many standing records date from each year, per statistic.

    Years run without gaps from the first to the last year that holds a
    record; a year without any counts 0.
    """
    return densify(_counts_by_year(stats), KEYS, "year").fillna(0)


def daily_records_set(stats: DataFrame) -> DataFrame:
    """Record counts by year, only years in which some record was set.

    Works on daily and on monthly statistics.
    """
    total = sum((F.col(n) for n in record_names(stats.columns)), F.lit(0))
    return _counts_by_year(stats).where(total > 0)


def annual_record_series(
    stats: DataFrame, this_year: int, start_year: int | None = None
) -> DataFrame:
    """Record counts by year through `this_year`, one row per statistic and year.

    The axis begins with the series' first year that holds a record, or with
    `start_year`; records from before that year are then left out.
    """
    names = record_names(stats.columns)
    axis = densify(_counts_by_year(stats), KEYS, "year", start_year, this_year).fillna(0)
    series = F.array(
        *[F.struct(F.lit(n).alias("record"), F.col(n).alias("n_records")) for n in names]
    )
    return axis.select(*KEYS, "year", F.inline(series))


def _set_in(stats: DataFrame, year: int) -> Column:
    """Records of a row that were set in the given year."""
    hits = [
        F.coalesce((F.col(f"{n}_year") == year).cast("int"), F.lit(0))
        for n in record_names(stats.columns)
    ]
    return sum(hits, F.lit(0))


def records_this_and_last_year(stats: DataFrame, this_year: int) -> DataFrame:
    """Number of standing records set this year and last year."""
    return stats.groupBy(*KEYS).agg(
        F.sum(_set_in(stats, this_year)).alias("this_year"),
        F.sum(_set_in(stats, this_year - 1)).alias("last_year"),
    )


def record_row_flags(stats: DataFrame, this_year: int) -> DataFrame:
    """For each label and statistic: was the record set this year?"""
    return stats.select(
        *KEYS,
        axis_column(stats.columns),
        label_column(stats.columns),
        *[
            F.coalesce(F.col(f"{n}_year") == this_year, F.lit(False)).alias(f"{n}_is_new")
            for n in record_names(stats.columns)
        ],
    )


def stats_table(
    stats: DataFrame, ranges: DataFrame, variable: str | None = None
) -> DataFrame:
    """Statistics rounded for display, with the span of the data record.

    An unknown variable gives an empty table; see `table_header` for the text.
    """
    if variable is not None:
        stats = stats.where(F.col(VARIABLE) == variable)
        ranges = ranges.where(F.col(VARIABLE) == variable)
    kept = {*KEYS, axis_column(stats.columns), label_column(stats.columns), "years"}
    rounded = [
        F.col(c) if c in kept or c.endswith("_year") else round_stat(VARIABLE, c).alias(c)
        for c in stats.columns
    ]
    subtitle = F.concat(F.lit("Readings of "), format_range("start_date", "end_date"))
    spans = ranges.select(*KEYS, subtitle.alias("subtitle"))
    return stats.select(*rounded).join(spans, KEYS, "left")


def table_header(
    requested: DataFrame, stats: DataFrame, this_year: int
) -> DataFrame:
    """Heading of the table of each requested station and variable.

    Tells how many records fell this year and last year, or that the station
    has no such data.
    """
    kind = "daily" if axis_column(stats.columns) == "yearday" else "monthly"
    counts = records_this_and_last_year(stats, this_year)
    name = F.lower(VARIABLE)
    heading = F.concat(
        name,
        F.lit(f", {kind} records: "),
        F.col("this_year").cast("string"),
        F.lit(" from this year, "),
        F.col("last_year").cast("string"),
        F.lit(" from the year before"),
    )
    missing = F.concat(name, F.lit(f": no {kind} statistics here"))
    return (
        requested.select(*KEYS)
        .join(counts, KEYS, "left")
        .select(*KEYS, F.coalesce(heading, missing).alias("heading"))
    )


def today_value(
    stats: DataFrame, units: DataFrame, as_of: Column, record: str, decimals: int = 1
) -> DataFrame:
    """One statistic on the calendar day of `as_of`, as text with its unit."""
    today = stats.where(F.col("date_label") == F.date_format(F.to_date(as_of), "dd-MMM"))
    value = F.coalesce(round_half_even(record, decimals).cast("string"), F.lit("nan"))
    return today.join(units.select(*KEYS, "unit"), KEYS, "left").select(
        *KEYS, "date_label", F.concat_ws(" ", value, F.col("unit")).alias("value")
    )


def axis_bounds(stats: DataFrame, divisor: int | None = None) -> DataFrame:
    """Plot bounds: lowest record low rounded down, highest record high up.

    The divisor is 10 for daily and 1 for monthly statistics.
    """
    if divisor is None:
        divisor = 10 if axis_column(stats.columns) == "yearday" else 1
    bounds = stats.groupBy(*KEYS).agg(
        F.min("record_low").alias("low"), F.max("record_high").alias("high")
    )
    return bounds.select(
        *KEYS,
        round_down("low", divisor).alias("y_min"),
        round_up("high", divisor).alias("y_max"),
    )
