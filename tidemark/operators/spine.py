"""Dense axes: one row for every step of a calendar, with NULL in the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_from_number, month_number


def _bound(value: int | Column) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def densify(
    df: DataFrame,
    keys: list[str],
    axis: str,
    start: int | Column | None = None,
    stop: int | Column | None = None,
) -> DataFrame:
    """Give each key one row per integer step of `axis`.

    The axis runs from the key's first to its last step, or from `start` to
    `stop` where given (rows outside are dropped; a column must be constant
    within a key). Every row also emits the gap
    before it, so the input is read once and nothing is joined. The window
    group is one key's series on a calendar axis: its size is bounded by the
    calendar, not by the number of observations.
    """
    order = Window.partitionBy(*keys).orderBy(axis)
    step = F.col(axis)
    before = F.lag(axis).over(order)
    is_last = F.lead(axis).over(order).isNull()

    lo, hi = before + 1, step
    if start is None:
        lo = F.coalesce(lo, step)
    else:
        lo = F.greatest(lo, _bound(start))
    if stop is not None:
        hi = F.when(is_last, _bound(stop)).otherwise(F.least(step, _bound(stop)))

    values = [c for c in df.columns if c not in keys and c != axis]
    ranged = df.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi")
    steps = ranged.withColumn("__step", F.explode(F.sequence("__lo", "__hi")))
    return steps.selectExpr(
        *[f"`{k}`" for k in keys],
        f"CAST(__step AS INT) AS `{axis}`",
        *[f"CASE WHEN __step = `{axis}` THEN `{c}` END AS `{c}`" for c in values],
    )


def calendar_spine(df: DataFrame, keys: list[str], date: str = "date", unit: str = "day") -> DataFrame:
    """Every day (or month) from a key's first to its last one, gaps as NULL rows."""
    if unit == "day":
        axis, back = F.unix_date(F.col(date)), F.date_from_unix_date(F.col("__axis"))
    elif unit == "month":
        axis, back = month_number(date), month_from_number("__axis")
    else:
        raise ValueError(f"unit must be 'day' or 'month', not {unit!r}")
    order = df.columns
    dense = densify(df.withColumn("__axis", axis).drop(date), keys, "__axis")
    return dense.withColumn(date, back).select(*order)
