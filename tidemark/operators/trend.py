"""Long-term trend of a monthly series.

Every step is a window over one series of months, so the whole chain shares a
single exchange on the series key. A series has one row per calendar month:
its length is bounded by the calendar however many readings a station has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.calendar import format_range, month_from_number, month_number
from tidemark.functions.scalars import round_half_even
from tidemark.operators.daily import month_series
from tidemark.operators.spine import densify
from tidemark.schemas import DAY_THRESHOLD, KEYS, STATION, VARIABLE, WATER_LEVEL

# Fixed value: the season length of the decomposition.
PERIOD = 4


def _series() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def _by_month() -> WindowSpec:
    return _series().orderBy("month_start")


def monthly_series(
    daily: DataFrame,
    variable: str | None = None,
    average: str = "midrange",
    day_threshold: int | Column = DAY_THRESHOLD,
) -> DataFrame:
    """Monthly means on every month the station's record spans.

    The span covers all variables of the station, so a variable that starts
    late or ends early has missing months at its ends.
    """
    return series_of_months(month_series(daily, average, day_threshold), variable)


def series_of_months(months: DataFrame, variable: str | None = None) -> DataFrame:
    """`monthly_series` from good months."""
    station = Window.partitionBy(STATION)
    months = months.select(
        *KEYS, month_number("month_start").alias("month"), F.col("mean").alias("value")
    )
    months = months.withColumns(
        {"first": F.min("month").over(station), "last": F.max("month").over(station)}
    )
    if variable is not None:
        months = months.where(F.col(VARIABLE) == variable)
    # The bounds are the same on every row of a station.
    keys = [*KEYS, "first", "last"]
    dense = densify(months, keys, "month", F.col("first"), F.col("last"))
    return dense.select(*KEYS, month_from_number("month").alias("month_start"), "value")


def trim_ends(series: DataFrame) -> DataFrame:
    """Without the missing months before the first and after the last value."""
    given = F.when(F.col("value").isNotNull(), F.col("month_start"))
    bounds = {"first": F.min(given).over(_series()), "last": F.max(given).over(_series())}
    kept = (F.col("month_start") >= F.col("first")) & (F.col("month_start") <= F.col("last"))
    return series.withColumns(bounds).where(kept).drop(*bounds)


def row_index(series: DataFrame) -> DataFrame:
    """Number the months of a dense series from 0."""
    return series.withColumn("rownum", F.row_number().over(_by_month()) - 1)


def interpolate_gaps(series: DataFrame) -> DataFrame:
    """Fill missing months on a straight line between their neighbours."""
    given = F.when(F.col("value").isNotNull(), F.struct("rownum", "value"))
    backward = _series().orderBy(F.col("month_start").desc())
    ends = {
        # The running frame keeps both directions linear in the series length.
        "before": F.last(given, ignorenulls=True).over(
            _by_month().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
        "after": F.last(given, ignorenulls=True).over(
            backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    }
    share = F.try_divide(
        F.col("rownum") - F.col("before.rownum"), F.col("after.rownum") - F.col("before.rownum")
    )
    line = F.col("before.value") + share * (F.col("after.value") - F.col("before.value"))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(line)
    return series.withColumns(ends).withColumn("linear_fill", filled).drop(*ends)


def minmax_normalise(series: DataFrame, column: str = "linear_fill") -> DataFrame:
    """Scale a series to 0..1; a constant series becomes NULL."""
    low, high = F.min(column).over(_series()), F.max(column).over(_series())
    return series.withColumns({"__low": low, "__high": high}).select(
        *series.columns,
        F.try_divide(F.col(column) - F.col("__low"), F.col("__high") - F.col("__low")).alias(
            "normalised"
        ),
    )


def seasonal_decompose(
    series: DataFrame, column: str = "linear_fill", period: int = PERIOD
) -> DataFrame:
    """Additive decomposition into trend, season and remainder.

    The trend is the centred moving average over one period, with half weights
    at both ends if the period is even; it is missing where the average does
    not fit. The season is the mean detrended value of each phase, shifted to
    average zero. Needs a dense series with `rownum`.
    """
    half = period // 2
    y = F.col(column)
    total = F.sum(y).over(_by_month().rowsBetween(-half, half))
    head, tail = F.lag(y, half).over(_by_month()), F.lead(y, half).over(_by_month())
    fits = head.isNotNull() & tail.isNotNull()
    if period % 2 == 0:
        total = total - (head + tail) / 2
    with_trend = series.withColumn("trend", F.when(fits, total / period))

    phase = F.pmod(F.col("rownum"), F.lit(period))
    detrended = y - F.col("trend")
    means = {
        f"__phase{j}": F.avg(F.when(phase == j, detrended)).over(_series()) for j in range(period)
    }
    centre = sum((F.col(c) for c in means), F.lit(0.0)) / period
    seasonal = F.element_at(F.array(*means), (phase + 1).cast("int")) - centre
    return (
        with_trend.withColumns(means)
        .withColumn("seasonal", seasonal)
        .drop(*means)
        .withColumn("residual", y - F.col("trend") - F.col("seasonal"))
    )


def deseasonalise(
    series: DataFrame, column: str = "linear_fill", period: int = PERIOD
) -> DataFrame:
    """The series without its season, in its own scale.

    Scaling to 0..1 and back does not change the result, so it is left out.
    """
    parts = seasonal_decompose(series, column, period)
    return parts.select(*series.columns, (F.col(column) - F.col("seasonal")).alias("deseasoned"))


def linear_trend(series: DataFrame, column: str = "deseasoned") -> DataFrame:
    """Least squares line over the month number, with its fitted values."""
    y, x = F.col(column), F.col("rownum")
    coefficients = {
        "slope": F.regr_slope(y, x).over(_series()),
        "intercept": F.regr_intercept(y, x).over(_series()),
    }
    return series.withColumns(coefficients).withColumn(
        "linear_reg", F.col("intercept") + F.col("slope") * x
    )


def mask_interpolated(series: DataFrame) -> DataFrame:
    """Deseasoned values only where the month was observed."""
    return series.withColumn("masked", F.when(F.col("value").isNotNull(), F.col("deseasoned")))


def trend(
    daily: DataFrame,
    variable: str = WATER_LEVEL,
    average: str = "midrange",
    day_threshold: int | Column = DAY_THRESHOLD,
    period: int = PERIOD,
) -> DataFrame:
    """The whole chain from monthly means to the trend line, for one variable.

    The variable is picked before anything else, so that the filter reaches the
    scan; the longer span of other variables would be trimmed anyway.
    """
    one = daily.where(F.col(VARIABLE) == variable)
    return trend_of_months(month_series(one, average, day_threshold), variable, period)


def trend_of_months(
    months: DataFrame, variable: str = WATER_LEVEL, period: int = PERIOD
) -> DataFrame:
    """`trend` from good months."""
    one = months.where(F.col(VARIABLE) == variable)
    series = row_index(trim_ends(series_of_months(one, variable)))
    fitted = linear_trend(deseasonalise(interpolate_gaps(series), period=period))
    return mask_interpolated(fitted)


def trend_rates(fitted: DataFrame) -> DataFrame:
    """Slope per year and per century, with the span of the series."""
    return (
        fitted.groupBy(*KEYS)
        .agg(
            F.min("month_start").alias("start_month"),
            F.max("month_start").alias("end_month"),
            F.max("slope").alias("slope"),
        )
        .select(
            *KEYS,
            "start_month",
            "end_month",
            round_half_even(F.col("slope") * 12, 4).alias("per_year"),
            round_half_even(F.col("slope") * 1200, 2).alias("per_century"),
        )
    )


def _plain_number(c: str) -> Column:
    """A number of at most four places as text, never with an exponent."""
    digits = F.col(c).cast("decimal(18,4)").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def trend_title(rates: DataFrame, units: DataFrame) -> DataFrame:
    """Heading of a trend: span, and rate per year and per century.

    Months are shown by their last day.
    """
    span = format_range(F.last_day("start_month"), F.last_day("end_month"))
    heading = F.concat(
        F.lit("Trend of "),
        F.lower(VARIABLE),
        F.lit(", "),
        span,
        F.lit(": "),
        _plain_number("per_year"),
        F.concat(F.lit(" "), F.col("unit")),
        F.lit(" a year, "),
        _plain_number("per_century"),
        F.concat(F.lit(" "), F.col("unit")),
        F.lit(" a century"),
    )
    return rates.join(units.select(*KEYS, "unit"), KEYS).select(*KEYS, heading.alias("heading"))


def trend_axis(series: DataFrame) -> DataFrame:
    """Plot bounds of series that are below zero throughout, else NULL."""
    below = F.max("value") < 0
    return series.groupBy(*KEYS).agg(
        F.when(below, -F.max(F.abs("value")) - 0.5).alias("y_min"),
        F.when(below, F.lit(0.45)).alias("y_max"),
    )
