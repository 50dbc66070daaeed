"""Work on published statistics: select, annotate, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import round_half_even
from tidemark.operators.daily import average_column
from tidemark.schemas import (
    KEYS,
    STATION,
    VARIABLE,
    WATER_LEVEL,
    axis_column,
    label_column,
    record_names,
)

# Averages are sums of doubles in no fixed order; a difference this small
# (relative) is not a change. Extremes of readings are held against each other
# exactly.
TOLERANCE = 1e-9


def select_variable(stats: DataFrame, variable: str) -> DataFrame:
    """Statistics of one variable."""
    return stats.where(F.col(VARIABLE) == variable).drop(VARIABLE)


def attach_thresholds(
    stats: DataFrame, thresholds: DataFrame, levels: tuple[str, ...] = ("major", "moderate", "minor")
) -> DataFrame:
    """Flood levels of the station beside its water level statistics."""
    wide = thresholds.groupBy(STATION).agg(
        *[
            F.max(F.when(F.col("level") == level, F.col("value"))).alias(f"{level}_threshold")
            for level in levels
        ]
    )
    return stats.where(F.col(VARIABLE) == WATER_LEVEL).join(wide, STATION, "left")


def current_year_records(stats: DataFrame, year: int) -> DataFrame:
    """Record highs and lows that were set in the given year, else NULL."""
    return stats.withColumns(
        {
            "high_records": F.when(F.col("record_high_year") == year, F.col("record_high")),
            "low_records": F.when(F.col("record_low_year") == year, F.col("record_low")),
        }
    )


def drop_empty_stats(
    stats: DataFrame, filled: dict[str, int], keep: list[str] | None = None
) -> DataFrame:
    """Without the columns that hold no value at all.

    `filled` tells how many values each column has, as the manifest of a stored
    table does (`filled_columns`) or, for any other frame, `count_filled`. So no
    job runs while the plan is built.
    """
    keep = KEYS if keep is None else keep
    return stats.select(*[c for c in stats.columns if c in keep or filled.get(c, 1) > 0])


def count_filled(stats: DataFrame) -> dict[str, int]:
    """Values in each column: one aggregate, whose single row the driver gets."""
    return stats.agg(*[F.count(F.col(c)).alias(c) for c in stats.columns]).first().asDict()


def _is_sum(name: str, columns: list[str]) -> bool:
    """Whether a statistic has been summed; in monthly tables all are from averages."""
    return not name.endswith("year") and ("average" in name or axis_column(columns) == "month")


def _same(a: str, b: str, summed: bool = True) -> str:
    """Equal or both missing; sums may differ by the order of summation."""
    if not summed:
        return f"({a} <=> {b})"
    near = f"abs({a} - {b}) <= {TOLERANCE} * greatest(1, abs({a}), abs({b}))"
    return f"coalesce({near}, {a} IS NULL AND {b} IS NULL)"


def _pair(old: DataFrame, new: DataFrame, how: str) -> DataFrame:
    """Old and new rows of the same label side by side as structs."""
    axis = axis_column(new.columns)
    keys = [*KEYS, axis]

    def packed(df: DataFrame, name: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        return df.select(*keys, F.struct(*values).alias(name))

    return packed(old, "old").join(packed(new, "new"), keys, how)


def stats_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each station: does any statistic differ between two tables?"""
    axis, label = axis_column(new.columns), label_column(new.columns)
    stats = [c for c in new.columns if c not in (*KEYS, axis, label)]
    same = " AND ".join(
        ["old IS NOT NULL", "new IS NOT NULL", *[_same(f"old.{c}", f"new.{c}", _is_sum(c, new.columns)) for c in stats]]
    )
    pairs = _pair(old, new, "full")
    return pairs.groupBy(STATION).agg(F.expr(f"bool_or(NOT ({same}))").alias("changed"))


def new_records(old: DataFrame, new: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Records whose value or year changed, old beside new.

    Averages and year counts always move and are left out, as are records that
    are missing in the new table. `message` reads like a log line and is set
    where the value changed. `units` has (station_id, variable, unit).
    """
    label = label_column(new.columns)
    records = ", ".join(
        f"struct('{n}' AS record, new.{n} AS value, new.{n}_year AS year, "
        f"old.{n} AS old_value, old.{n}_year AS old_year)"
        for n in record_names(new.columns)
    )
    rows = _pair(old, new, "right").selectExpr(
        *KEYS, f"new.{label} AS {label}", f"inline(array({records}))"
    )
    sums = [n for n in record_names(new.columns) if _is_sum(n, new.columns)]
    value_changed = ~F.when(F.col("record").isin(sums), F.expr(_same("value", "old_value"))).otherwise(
        F.col("value").eqNullSafe(F.col("old_value"))
    )
    year_changed = ~F.col("year").eqNullSafe(F.col("old_year"))
    changed = rows.where(F.col("value").isNotNull() & (value_changed | year_changed))

    if units is None:
        changed = changed.withColumn("unit", F.lit(None).cast("string"))
    else:
        changed = changed.join(units.select(*KEYS, "unit"), KEYS, "left")
    words = F.replace(F.col("record"), F.lit("_"), F.lit(" "))
    title = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))

    def shown(c: str) -> Column:
        number = F.coalesce(round_half_even(c, 3).cast("string"), F.lit("nan"))
        return F.concat_ws(" ", number, F.col("unit"))

    message = F.concat(
        title,
        F.lit(" of "),
        F.lower(VARIABLE),
        F.lit(" on "),
        F.col(label),
        F.lit(" is "),
        shown("value"),
        F.lit(" ("),
        F.col("year").cast("string"),
        F.lit("), was "),
        shown("old_value"),
        F.lit(" ("),
        F.coalesce(F.col("old_year").cast("string"), F.lit("nan")),
        F.lit(")"),
    )
    return changed.select(
        *KEYS,
        label,
        "record",
        "value",
        "year",
        "old_value",
        "old_year",
        F.when(value_changed, message).alias("message"),
    )


def yesterday_summary(
    daily: DataFrame, as_of: Column, average: str | Column = "midrange"
) -> DataFrame:
    """Average, high and low of the day before `as_of`, if it was a good day."""
    day = F.date_sub(F.to_date(as_of), 1)
    good = (F.col("date") == day) & F.col("good_day") & F.col("high").isNotNull()
    return daily.where(good).select(
        *KEYS, "date", average_column(average).alias("average"), "high", "low"
    )
