"""Statistics by day and by month of the year."""

from __future__ import annotations

from catalog.base import (
    _DAY_STATS,
    _MONTH_STATS,
    DAILY_LONG,
    DAILY_STATS_LONG,
    DAYS,
    LONG_DAY,
    MONTHLY_STATS_LONG,
    MONTHS,
    daily_long,
    marked_sql,
    query,
    rounded,
    stat_sql,
)
from tidemark.operators import normals as S

_K = "station_id, variable"

_BY_DAY = {
    "daily_avg": ("daily_average", S.daily_avg),
    "record_high_daily_avg": ("record_high_daily_average", S.record_high_daily_avg),
    "record_low_daily_avg": ("record_low_daily_average", S.record_low_daily_avg),
    "avg_daily_high": ("average_high", S.avg_daily_high),
    "lowest_daily_high": ("lowest_high", S.lowest_daily_high),
    "record_daily_high": ("record_high", S.record_daily_high),
    "avg_daily_low": ("average_low", S.avg_daily_low),
    "highest_daily_low": ("highest_low", S.highest_daily_low),
    "record_daily_low": ("record_low", S.record_daily_low),
    "number_of_years_byday": ("years", S.number_of_years_byday),
}
_BY_MONTH = {
    "monthly_avg": ("monthly_average", S.monthly_avg),
    "record_high_monthly_avg": ("record_high_monthly_average", S.record_high_monthly_avg),
    "record_low_monthly_avg": ("record_low_monthly_average", S.record_low_monthly_avg),
    "avg_monthly_high": ("average_high", S.avg_monthly_high),
    "lowest_monthly_high": ("lowest_high", S.lowest_monthly_high),
    "record_monthly_high": ("record_high", S.record_monthly_high),
    "avg_monthly_low": ("average_low", S.avg_monthly_low),
    "highest_monthly_low": ("highest_low", S.highest_monthly_low),
    "record_monthly_low": ("record_low", S.record_monthly_low),
    "number_of_years_bymonth": ("years", S.number_of_years_bymonth),
}


def _register_by_day(name: str, stat: str, fn) -> None:
    spec = next(s for s in _DAY_STATS if s[0] == stat)
    sql = f"""{DAILY_LONG},
{DAYS},
{marked_sql('days', 'yearday', ['mid', 'high', 'low'])}
SELECT {_K}, yearday, {stat_sql(*spec)} FROM marked GROUP BY {_K}, yearday"""
    query(name, sql)(lambda spark, sf_dir: rounded(fn(daily_long(spark, sf_dir))))


def _register_by_month(name: str, stat: str, fn) -> None:
    spec = next(s for s in _MONTH_STATS if s[0] == stat)
    sql = f"""{DAILY_LONG},
{MONTHS},
{marked_sql('monthly', 'month', ['mean', 'high', 'low'])}
SELECT {_K}, month, {stat_sql(*spec)} FROM marked GROUP BY {_K}, month"""
    query(name, sql)(
        lambda spark, sf_dir: rounded(fn(daily_long(spark, sf_dir), day_threshold=LONG_DAY))
    )


for _name, (_stat, _fn) in _BY_DAY.items():
    _register_by_day(_name, _stat, _fn)
for _name, (_stat, _fn) in _BY_MONTH.items():
    _register_by_month(_name, _stat, _fn)


@query("daily_stats", f"{DAILY_STATS_LONG}\nSELECT * FROM stats")
def daily_stats(spark, sf_dir):
    return rounded(S.daily_stats(daily_long(spark, sf_dir)))


@query("monthly_stats", f"{MONTHLY_STATS_LONG}\nSELECT * FROM stats")
def monthly_stats(spark, sf_dir):
    return rounded(S.monthly_stats(daily_long(spark, sf_dir), day_threshold=LONG_DAY))


@query(
    "data_range",
    f"""{DAILY_LONG}
SELECT {_K}, min(date) AS start_date, max(date) AS end_date
FROM daily WHERE good_day AND high IS NOT NULL GROUP BY {_K}""",
)
def data_range(spark, sf_dir):
    return S.data_range(daily_long(spark, sf_dir))


@query(
    "data_range_monthly",
    f"""{DAILY_LONG}
SELECT {_K}, min(date) AS start_date, max(date) AS end_date
FROM daily WHERE good_day AND good_month AND high IS NOT NULL GROUP BY {_K}""",
)
def data_range_monthly(spark, sf_dir):
    return S.data_range(daily_long(spark, sf_dir), "monthly", LONG_DAY)
