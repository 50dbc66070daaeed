"""Quality gates, daily series and month series."""

from __future__ import annotations

from catalog.base import (
    DAILY_HOURLY,
    DAILY_LONG,
    DAYS,
    LONG_DAY,
    LONG_HR,
    MONTHS,
    daily_hourly,
    daily_long,
    obs_hourly,
    obs_long,
    query,
    r6,
    rounded,
)
from tidemark.operators import daily as D
from tidemark.operators import quality as Q
from tidemark.operators.spine import calendar_spine
from tidemark.schemas import KEYS

_K = "station_id, variable"


@query(
    "good_day",
    f"""{DAILY_HOURLY}
SELECT {_K}, date, {r6('high', 'low', 'mean', 'mid')}, n_hours, preliminary, last_obs, good_day FROM daily""",
)
def good_day(spark, sf_dir):
    return rounded(Q.good_day(Q.daily_summary(obs_hourly(spark, sf_dir))))


@query(
    "good_month",
    f"""{DAILY_LONG}
SELECT {_K}, date, {r6('high', 'low', 'mean', 'mid')}, n_hours, preliminary, last_obs, good_day, good_month FROM daily""",
)
def good_month(spark, sf_dir):
    return rounded(daily_long(spark, sf_dir))


@query(
    "filter_days_by_hours",
    f"""{DAILY_HOURLY}
SELECT o.station_id, o.variable, o.ts, nullif(o.value, 31.8) AS value, o.qc
FROM obs o JOIN daily d ON d.station_id = o.station_id AND d.variable = o.variable
                       AND d.date = CAST(o.ts AS DATE)
WHERE d.good_day""",
)
def filter_days_by_hours(spark, sf_dir):
    return Q.filter_days_by_hours(obs_hourly(spark, sf_dir))


@query(
    "filter_months_by_days",
    f"""{DAILY_LONG}
SELECT o.station_id, o.variable, o.ts, nullif(o.value, 31.8) AS value, o.qc
FROM obs o JOIN daily d ON d.station_id = o.station_id AND d.variable = o.variable
                       AND d.date = CAST(o.ts AS DATE)
WHERE d.good_day AND d.good_month""",
)
def filter_months_by_days(spark, sf_dir):
    return Q.filter_months_by_days(obs_long(spark, sf_dir), LONG_HR, LONG_DAY)


def _daily_sql(prefix: str, gate: str, value: str, name: str) -> str:
    return f"""{prefix}
SELECT {_K}, date, round({value}, 6) AS {name} FROM daily WHERE {gate} AND high IS NOT NULL"""


@query("daily_highs", _daily_sql(DAILY_HOURLY, "good_day", "high", "high"))
def daily_highs(spark, sf_dir):
    return rounded(D.daily_highs(daily_hourly(spark, sf_dir)))


@query("daily_lows", _daily_sql(DAILY_HOURLY, "good_day", "low", "low"))
def daily_lows(spark, sf_dir):
    return rounded(D.daily_lows(daily_hourly(spark, sf_dir)))


@query("daily_avgs", _daily_sql(DAILY_HOURLY, "good_day", "mid", "average"))
def daily_avgs(spark, sf_dir):
    return rounded(D.daily_avgs(daily_hourly(spark, sf_dir)))


@query("daily_avgs_mean", _daily_sql(DAILY_HOURLY, "good_day", "mean", "average"))
def daily_avgs_mean(spark, sf_dir):
    return rounded(D.daily_avgs(daily_hourly(spark, sf_dir), "mean"))


_BOTH = "good_day AND good_month"


@query("mon_daily_highs", _daily_sql(DAILY_LONG, _BOTH, "high", "high"))
def mon_daily_highs(spark, sf_dir):
    return rounded(D.mon_daily_highs(daily_long(spark, sf_dir)))


@query("mon_daily_lows", _daily_sql(DAILY_LONG, _BOTH, "low", "low"))
def mon_daily_lows(spark, sf_dir):
    return rounded(D.mon_daily_lows(daily_long(spark, sf_dir)))


@query("mon_daily_avgs", _daily_sql(DAILY_LONG, _BOTH, "mid", "average"))
def mon_daily_avgs(spark, sf_dir):
    return rounded(D.mon_daily_avgs(daily_long(spark, sf_dir)))


@query("mon_daily_avgs_mean", _daily_sql(DAILY_LONG, _BOTH, "mean", "average"))
def mon_daily_avgs_mean(spark, sf_dir):
    return rounded(D.mon_daily_avgs(daily_long(spark, sf_dir), "mean"))


def _month_sql(column: str) -> str:
    return f"""{DAILY_LONG},
{MONTHS}
SELECT {_K}, month_start, round({column}, 6) AS {column} FROM months"""


@query("monthly_highs", _month_sql("high"))
def monthly_highs(spark, sf_dir):
    return rounded(D.monthly_highs(daily_long(spark, sf_dir), day_threshold=LONG_DAY))


@query("monthly_lows", _month_sql("low"))
def monthly_lows(spark, sf_dir):
    return rounded(D.monthly_lows(daily_long(spark, sf_dir), day_threshold=LONG_DAY))


@query("monthly_means", _month_sql("mean"))
def monthly_means(spark, sf_dir):
    return rounded(D.monthly_means(daily_long(spark, sf_dir), day_threshold=LONG_DAY))


@query(
    "calendar_spine",
    f"""{DAILY_LONG},
{DAYS},
span AS (SELECT {_K}, min(date) AS a, max(date) AS b FROM days GROUP BY {_K}),
axis AS (SELECT {_K}, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT x.station_id, x.variable, x.date, round(d.high, 6) AS high
FROM axis x LEFT JOIN days d ON d.station_id = x.station_id AND d.variable = x.variable
                            AND d.date = x.date""",
)
def calendar_spine_days(spark, sf_dir):
    return rounded(calendar_spine(D.daily_highs(daily_long(spark, sf_dir)), KEYS))


@query(
    "calendar_spine_months",
    f"""{DAILY_LONG},
{MONTHS},
span AS (SELECT {_K}, min(month_start) AS a, max(month_start) AS b FROM months GROUP BY {_K}),
axis AS (SELECT {_K}, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)
                AS month_start FROM span)
SELECT x.station_id, x.variable, x.month_start, round(m.mean, 6) AS mean
FROM axis x LEFT JOIN months m ON m.station_id = x.station_id AND m.variable = x.variable
                              AND m.month_start = x.month_start""",
)
def calendar_spine_months(spark, sf_dir):
    means = D.monthly_means(daily_long(spark, sf_dir), day_threshold=LONG_DAY)
    return rounded(calendar_spine(means, KEYS, "month_start", "month"))
