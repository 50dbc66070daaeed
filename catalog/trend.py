"""Seasonal curves and the long-term trend."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import (
    DAILY_LONG,
    DAILY_STATS_LONG,
    LONG_DAY,
    MONTHLY_STATS_LONG,
    MONTHS,
    daily_long,
    obs_long,
    query,
    r6,
    rounded,
)
from catalog.published import stats_long
from tidemark.dimensions import station_units
from tidemark.operators import curves as V
from tidemark.operators import trend as R

_K = "station_id, variable"


def _fit_sql(prefix: str, axis: str, length: int, average: str) -> str:
    curves = ["average_high", average, "average_low"]
    parts, fits = [], []
    for c in curves:
        over = f"OVER (PARTITION BY {_K})"
        cos, sin = (f"CASE WHEN {c} IS NOT NULL THEN {f}(x) END" for f in ("cos", "sin"))
        parts += [
            f"avg({c}) {over} AS {c}_my",
            f"avg({cos}) {over} AS {c}_mc",
            f"avg({sin}) {over} AS {c}_ms",
            f"var_pop({cos}) {over} AS {c}_cc",
            f"var_pop({sin}) {over} AS {c}_ss",
            f"covar_pop({cos}, {sin}) {over} AS {c}_cs",
            f"covar_pop({cos}, {c}) {over} AS {c}_cy",
            f"covar_pop({sin}, {c}) {over} AS {c}_sy",
        ]
        det = f"({c}_cc * {c}_ss - {c}_cs * {c}_cs)"
        a = f"(({c}_cy * {c}_ss - {c}_sy * {c}_cs) / {det})"
        b = f"(({c}_sy * {c}_cc - {c}_cy * {c}_cs) / {det})"
        fits.append(
            f"""CASE WHEN {det} > 1e-12 THEN
              round({c}_my + {a} * (cos(x) - {c}_mc) + {b} * (sin(x) - {c}_ms), 6) END
              AS {c}_curve"""
        )
    return f"""{prefix},
placed AS (SELECT *, ({axis} - 1) / {length}.0::DOUBLE * {2 * math.pi!r}::DOUBLE AS x FROM stats),
sums AS (SELECT *, {', '.join(parts)} FROM placed)
SELECT {_K}, {axis}, {', '.join(curves)}, {', '.join(fits)} FROM sums"""


@query("harmonic_fit", _fit_sql(DAILY_STATS_LONG, "yearday", 366, "daily_average"))
def harmonic_fit(spark, sf_dir):
    curves = ["average_high", "daily_average", "average_low"]
    fitted = V.harmonic_fit(rounded(stats_long(spark, sf_dir)))
    return rounded(
        fitted.select("station_id", "variable", "yearday", *curves, *[f"{c}_curve" for c in curves])
    )


@query("harmonic_fit_monthly", _fit_sql(MONTHLY_STATS_LONG, "month", 12, "monthly_average"))
def harmonic_fit_monthly(spark, sf_dir):
    curves = ["average_high", "monthly_average", "average_low"]
    fitted = V.harmonic_fit(rounded(stats_long(spark, sf_dir, "monthly")))
    return rounded(
        fitted.select("station_id", "variable", "month", *curves, *[f"{c}_curve" for c in curves])
    )


def _search_sql(prefix: str, axis: str, length: int, curves: list[str]) -> str:
    """Best of a grid of frequencies, then of two finer grids around it."""

    def step(name: str, tried: str) -> str:
        return f"""{name}_sums AS (
  SELECT {_K}, curve, f, avg(y) AS my, avg(cos(p * f)) AS mc, avg(sin(p * f)) AS ms,
         var_pop(y) AS yy, var_pop(cos(p * f)) AS cc, var_pop(sin(p * f)) AS ss,
         covar_pop(cos(p * f), sin(p * f)) AS cs,
         covar_pop(cos(p * f), y) AS cy, covar_pop(sin(p * f), y) AS sy
  FROM ({tried}) GROUP BY {_K}, curve, f),
{name}_fits AS (
  SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS a,
         (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b
  FROM {name}_sums WHERE cc * ss - cs * cs > 1e-12),
{name} AS (
  SELECT {_K}, curve, f, a, b, my - a * mc - b * ms AS c0, yy - a * cy - b * sy AS error
  FROM {name}_fits
  QUALIFY row_number() OVER (PARTITION BY {_K}, curve
                             ORDER BY yy - a * cy - b * sy, f) = 1)"""

    def around(name: str, width: str) -> str:
        return f"""SELECT q.*, b.f + g.i * {width}::DOUBLE AS f FROM points q
          JOIN {name} b ON b.station_id = q.station_id AND b.variable = q.variable
                       AND b.curve = q.curve, generate_series(-10, 10) AS g(i)"""

    union = " UNION ALL ".join(
        f"SELECT {_K}, '{c}' AS curve, ({axis} - 1) / {length}.0::DOUBLE AS p, {c} AS y FROM stats"
        for c in curves
    )
    n = round((4 * math.pi - 1) / 0.1)

    def further(name: str, k: int) -> str:
        """Goes on above the k-th range, or below the first, if the best lies at that end."""
        low = f"OR ({name}.i = 0 AND c.i BETWEEN -9 AND -1)" if k == 1 else ""
        return f"""SELECT c.* FROM coarse c JOIN {name} ON {name}.station_id = c.station_id
          AND {name}.variable = c.variable AND {name}.curve = c.curve
          AND (c.i = {name}.i OR ({name}.i = {k * n} AND c.i BETWEEN {k * n + 1} AND {(k + 1) * n}) {low})
          QUALIFY row_number() OVER (PARTITION BY c.station_id, c.variable, c.curve ORDER BY c.error, c.i) = 1"""

    grid = f"""SELECT q.*, 1.0::DOUBLE + g.i * 0.1::DOUBLE AS f
          FROM points q, generate_series(-9, {3 * n}) AS g(i)"""
    first = f"""SELECT * FROM coarse WHERE i BETWEEN 0 AND {n}
          QUALIFY row_number() OVER (PARTITION BY {_K}, curve ORDER BY error, i) = 1"""
    every = step("coarse0", grid).rsplit("  QUALIFY", 1)[0] + ")"
    return f"""{prefix},
points AS (SELECT * FROM ({union}) WHERE y IS NOT NULL),
{every},
coarse AS (SELECT *, CAST(round((f - 1) * 10) AS INTEGER) AS i FROM coarse0),
range0 AS ({first}),
range1 AS ({further('range0', 1)}),
range2 AS ({further('range1', 2)}),
{step('fine', around('range2', '0.01'))},
{step('best', around('fine', '0.001'))}"""


_MONTH_CURVES = ["average_high", "monthly_average", "average_low"]
_DAY_CURVES = ["average_high", "daily_average", "average_low"]


@query(
    "harmonic_search",
    f"""{_search_sql(MONTHLY_STATS_LONG, "month", 12, _MONTH_CURVES)}
SELECT {_K}, curve, round(f, 6) AS frequency, round(error, 6) AS error FROM best""",
)
def harmonic_search(spark, sf_dir):
    best = V.harmonic_search(rounded(stats_long(spark, sf_dir, "monthly")))
    return rounded(best.select("station_id", "variable", "curve", "frequency", "error"))


_FREE = ", ".join(
    f"""max(CASE WHEN b.curve = '{c}'
      THEN round(c0 + a * cos((yearday - 1) / 366.0::DOUBLE * f)
                 + b.b * sin((yearday - 1) / 366.0::DOUBLE * f), 4) END) AS {c}_curve"""
    for c in _DAY_CURVES
)


@query(
    "harmonic_fit_free",
    f"""{_search_sql(DAILY_STATS_LONG, "yearday", 366, _DAY_CURVES)}
SELECT s.station_id, s.variable, s.yearday, {_FREE}
FROM stats s LEFT JOIN best b ON b.station_id = s.station_id AND b.variable = s.variable
GROUP BY s.station_id, s.variable, s.yearday""",
)
def harmonic_fit_free(spark, sf_dir):
    fitted = V.harmonic_fit_free(rounded(stats_long(spark, sf_dir)))
    curves = [f"{c}_curve" for c in _DAY_CURVES]
    return rounded(fitted.select("station_id", "variable", "yearday", *curves), 4)


# --- trend -------------------------------------------------------------------

# The chain as SQL, each step on top of the one before.
TREND = f"""{DAILY_LONG},
{MONTHS},
span AS (SELECT station_id, min(month_start) AS a, max(month_start) AS b FROM months GROUP BY 1),
axis AS (
  SELECT k.station_id, k.variable,
         CAST(unnest(generate_series(s.a, s.b, INTERVAL 1 MONTH)) AS DATE) AS month_start
  FROM (SELECT DISTINCT {_K} FROM months) k JOIN span s ON s.station_id = k.station_id),
series AS (
  SELECT x.station_id, x.variable, x.month_start, m.mean AS value
  FROM axis x LEFT JOIN months m ON m.station_id = x.station_id AND m.variable = x.variable
                                AND m.month_start = x.month_start),
trimmed AS (
  SELECT * FROM series WINDOW k AS (PARTITION BY {_K}) QUALIFY
    month_start BETWEEN min(CASE WHEN value IS NOT NULL THEN month_start END) OVER k
                    AND max(CASE WHEN value IS NOT NULL THEN month_start END) OVER k),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY month_start) - 1 AS INTEGER)
    AS rownum FROM trimmed),
ends AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN rownum END IGNORE NULLS) OVER back AS r0,
    last_value(value IGNORE NULLS) OVER back AS v0,
    first_value(CASE WHEN value IS NOT NULL THEN rownum END IGNORE NULLS) OVER ahead AS r1,
    first_value(value IGNORE NULLS) OVER ahead AS v1
  FROM numbered
  WINDOW back AS (PARTITION BY {_K} ORDER BY month_start
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY {_K} ORDER BY month_start
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT {_K}, month_start, value, rownum,
    CASE WHEN value IS NOT NULL THEN value
         ELSE v0 + (rownum - r0) / CAST(r1 - r0 AS DOUBLE) * (v1 - v0) END AS linear_fill
  FROM ends),
averaged AS (
  SELECT *, CASE WHEN lag(linear_fill, 2) OVER w IS NOT NULL
                  AND lead(linear_fill, 2) OVER w IS NOT NULL THEN
    (lag(linear_fill, 2) OVER w / 2 + lag(linear_fill, 1) OVER w + linear_fill
     + lead(linear_fill, 1) OVER w + lead(linear_fill, 2) OVER w / 2) / 4 END AS trend
  FROM filled WINDOW w AS (PARTITION BY {_K} ORDER BY month_start)),
phases AS (
  SELECT station_id, variable, rownum % 4 AS phase, avg(linear_fill - trend) AS m
  FROM averaged GROUP BY station_id, variable, rownum % 4),
seasons AS (SELECT *, m - avg(m) OVER (PARTITION BY {_K}) AS seasonal FROM phases),
parted AS (
  SELECT a.*, s.seasonal, a.linear_fill - a.trend - s.seasonal AS residual,
         a.linear_fill - s.seasonal AS deseasoned
  FROM averaged a JOIN seasons s ON s.station_id = a.station_id AND s.variable = a.variable
                                AND s.phase = a.rownum % 4),
lined AS (
  SELECT *, regr_slope(deseasoned, rownum) OVER k AS slope,
         regr_intercept(deseasoned, rownum) OVER k AS intercept
  FROM parted WINDOW k AS (PARTITION BY {_K})),
fitted AS (
  SELECT *, intercept + slope * rownum AS linear_reg,
         CASE WHEN value IS NOT NULL THEN deseasoned END AS masked
  FROM lined)
"""


def zero6(c: str) -> str:
    """Rounded without a negative zero."""
    return f"CASE WHEN abs({c}) < 5e-7 THEN 0.0 ELSE round({c}, 6) END AS {c}"


def _numbered(spark, sf_dir):
    series = R.monthly_series(daily_long(spark, sf_dir), day_threshold=LONG_DAY)
    return R.row_index(R.trim_ends(series))


def _filled(spark, sf_dir):
    return R.interpolate_gaps(_numbered(spark, sf_dir))


@query("monthly_series", f"{TREND} SELECT {_K}, month_start, round(value, 6) AS value FROM series")
def monthly_series(spark, sf_dir):
    return rounded(R.monthly_series(daily_long(spark, sf_dir), day_threshold=LONG_DAY))


@query("trim_ends", f"{TREND} SELECT {_K}, month_start, round(value, 6) AS value FROM trimmed")
def trim_ends(spark, sf_dir):
    series = R.monthly_series(daily_long(spark, sf_dir), day_threshold=LONG_DAY)
    return rounded(R.trim_ends(series))


@query(
    "row_index", f"{TREND} SELECT {_K}, month_start, round(value, 6) AS value, rownum FROM numbered"
)
def row_index(spark, sf_dir):
    return rounded(_numbered(spark, sf_dir))


@query(
    "interpolate_gaps",
    f"{TREND} SELECT {_K}, month_start, {r6('value', 'linear_fill')}, rownum FROM filled",
)
def interpolate_gaps(spark, sf_dir):
    return rounded(_filled(spark, sf_dir))


@query(
    "minmax_normalise",
    f"""{TREND}
SELECT {_K}, month_start, {r6('value', 'linear_fill')}, rownum,
       round((linear_fill - min(linear_fill) OVER k)
         / (max(linear_fill) OVER k - min(linear_fill) OVER k), 6) AS normalised
FROM filled WINDOW k AS (PARTITION BY {_K})""",
)
def minmax_normalise(spark, sf_dir):
    return rounded(R.minmax_normalise(_filled(spark, sf_dir)))


@query(
    "seasonal_decompose",
    f"""{TREND}
SELECT {_K}, month_start, {r6('value', 'linear_fill', 'trend')}, rownum, {zero6('seasonal')},
       {zero6('residual')} FROM parted""",
)
def seasonal_decompose(spark, sf_dir):
    return rounded(R.seasonal_decompose(_filled(spark, sf_dir)))


@query(
    "deseasonalise",
    f"{TREND} SELECT {_K}, month_start, {r6('value', 'linear_fill', 'deseasoned')}, rownum FROM parted",
)
def deseasonalise(spark, sf_dir):
    return rounded(R.deseasonalise(_filled(spark, sf_dir)))


@query(
    "linear_trend",
    f"""{TREND}
SELECT {_K}, month_start, {r6('value', 'linear_fill', 'deseasoned')}, rownum, {zero6('slope')},
       {r6('intercept', 'linear_reg')} FROM fitted""",
)
def linear_trend(spark, sf_dir):
    return rounded(R.linear_trend(R.deseasonalise(_filled(spark, sf_dir))))


@query(
    "mask_interpolated",
    f"""{TREND}
SELECT {_K}, month_start, {r6('value', 'linear_fill', 'deseasoned', 'masked')}, rownum
FROM fitted""",
)
def mask_interpolated(spark, sf_dir):
    return rounded(R.mask_interpolated(R.deseasonalise(_filled(spark, sf_dir))))


@query(
    "trend",
    f"""{TREND}
SELECT {_K}, month_start, {r6('value', 'linear_fill', 'deseasoned')}, rownum, {zero6('slope')},
       {r6('intercept', 'linear_reg', 'masked')} FROM fitted WHERE variable = 'Water Level'""",
)
def trend(spark, sf_dir):
    return rounded(R.trend(daily_long(spark, sf_dir), day_threshold=LONG_DAY))


_RATES = f"""rates AS (
  SELECT {_K}, min(month_start) AS start_month, max(month_start) AS end_month,
         round_even(max(slope) * 12 * 10000.0, 0) / 10000.0 AS per_year,
         round_even(max(slope) * 1200 * 100.0, 0) / 100.0 AS per_century
  FROM fitted GROUP BY {_K})"""


def _all_trends(spark, sf_dir):
    return R.linear_trend(R.deseasonalise(_filled(spark, sf_dir)))


@query("trend_rates", f"{TREND}, {_RATES} SELECT * FROM rates")
def trend_rates(spark, sf_dir):
    return R.trend_rates(_all_trends(spark, sf_dir))


@query(
    "trend_title",
    f"""{TREND}, {_RATES}
SELECT {_K}, 'Trend of water level, ' || strftime(last_day(start_month), '%-m/%-d/%Y')
  || ' - ' || strftime(last_day(end_month), '%-m/%-d/%Y') || ': ' || per_year || ' ft a year, '
  || per_century || ' ft a century' AS heading
FROM rates WHERE variable = 'Water Level'""",
)
def trend_title(spark, sf_dir):
    rates = R.trend_rates(R.trend(daily_long(spark, sf_dir), day_threshold=LONG_DAY))
    return R.trend_title(rates, station_units(obs_long(spark, sf_dir)))


# Air temperatures are shifted below zero, so that their axis has bounds.
@query(
    "trend_axis",
    f"""{TREND},
shifted AS (
  SELECT {_K}, value - CASE WHEN variable = 'Air Temperature' THEN 100 ELSE 0 END AS value
  FROM trimmed)
SELECT {_K}, CASE WHEN max(value) < 0 THEN round(-max(abs(value)) - 0.5, 6) END AS y_min,
       CASE WHEN max(value) < 0 THEN 0.45::DOUBLE END AS y_max
FROM shifted GROUP BY {_K}""",
)
def trend_axis(spark, sf_dir):
    series = _numbered(spark, sf_dir)
    shift = F.when(F.col("variable") == "Air Temperature", 100).otherwise(0)
    return rounded(R.trend_axis(series.withColumn("value", F.col("value") - shift)))


