"""Published tables: selection, annotation, comparison, lookups and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    _DAY_STATS,
    DAILY_HOURLY,
    DAILY_LONG,
    DAILY_STATS_LONG,
    HOURLY_AS_OF,
    LONG_AS_OF,
    LONG_DAY,
    LONG_HR,
    MONTHLY_STATS_LONG,
    OBS_LONG,
    daily_hourly,
    daily_long,
    daily_sql,
    daily_stats_sql,
    monthly_stats_sql,
    obs_long,
    query,
    rounded,
    table,
)
from catalog.combine import ntz
from tidemark.dimensions import station_units
from tidemark.operators import analysis as A
from tidemark.operators import published as P
from tidemark.operators.normals import daily_stats, data_range, monthly_stats
from tidemark.operators.quality import daily_table
from tidemark.schemas import DAILY_STATS, MONTHLY_STATS, WATER_LEVEL, record_names

_K = "station_id, variable"
_YEAR = 2001


def stats_long(spark, sf_dir, kind="daily"):
    daily = daily_long(spark, sf_dir)
    if kind == "daily":
        return daily_stats(daily)
    return monthly_stats(daily, day_threshold=LONG_DAY)


def obs_before_2001(spark, sf_dir):
    return obs_long(spark, sf_dir).where(F.col("ts") < ntz("2001-01-01"))


def stats_before_2001(spark, sf_dir, kind="daily"):
    daily = daily_table(obs_before_2001(spark, sf_dir), LONG_HR, LONG_DAY)
    if kind == "daily":
        return daily_stats(daily)
    return monthly_stats(daily, day_threshold=LONG_DAY)


_BEFORE = f"""WITH {OBS_LONG},
obs_old AS (SELECT * FROM obs WHERE ts < TIMESTAMP '2001-01-01'),
{daily_sql(LONG_HR, LONG_DAY, 'obs_old')}"""


def _old_and_new(kind: str) -> str:
    make = daily_stats_sql if kind == "daily" else monthly_stats_sql
    return f"""WITH old AS ({make(_BEFORE)} SELECT * FROM stats),
new AS ({make(DAILY_LONG)} SELECT * FROM stats)"""


@query(
    "select_variable",
    f"""{DAILY_STATS_LONG}
SELECT * EXCLUDE (variable) FROM stats WHERE variable = 'Water Level'""",
)
def select_variable(spark, sf_dir):
    return rounded(P.select_variable(stats_long(spark, sf_dir), WATER_LEVEL))


@query(
    "select_variable_monthly",
    f"""{MONTHLY_STATS_LONG}
SELECT * EXCLUDE (variable) FROM stats WHERE variable = 'Air Temperature'""",
)
def select_variable_monthly(spark, sf_dir):
    return rounded(P.select_variable(stats_long(spark, sf_dir, "monthly"), "Air Temperature"))


@query(
    "attach_thresholds",
    f"""{DAILY_STATS_LONG},
levels AS (
  SELECT l_linestatus AS station_id,
         max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) / 1000 AS major,
         max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) / 1000 AS moderate,
         max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) / 1000 AS minor
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT s.*, round(l.major, 6) AS major_threshold, round(l.moderate, 6) AS moderate_threshold,
       round(l.minor, 6) AS minor_threshold
FROM stats s LEFT JOIN levels l ON l.station_id = s.station_id
WHERE s.variable = 'Water Level'""",
)
def attach_thresholds(spark, sf_dir):
    flag = F.col("l_returnflag")
    level = F.when(flag == "R", "major").when(flag == "N", "moderate").otherwise("minor")
    thresholds = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linestatus") == "O")
        .groupBy(F.col("l_linestatus").alias("station_id"), level.alias("level"))
        .agg((F.max("l_extendedprice") / 1000).alias("value"))
    )
    return rounded(P.attach_thresholds(stats_long(spark, sf_dir), thresholds))


@query(
    "current_year_records",
    f"""{DAILY_STATS_LONG}
SELECT *, CASE WHEN record_high_year = {_YEAR} THEN record_high END AS high_records,
       CASE WHEN record_low_year = {_YEAR} THEN record_low END AS low_records
FROM stats""",
)
def current_year_records(spark, sf_dir):
    return rounded(P.current_year_records(stats_long(spark, sf_dir), _YEAR))


@query(
    "current_year_records_monthly",
    f"""{MONTHLY_STATS_LONG}
SELECT *, CASE WHEN record_high_year = {_YEAR} THEN record_high END AS high_records,
       CASE WHEN record_low_year = {_YEAR} THEN record_low END AS low_records
FROM stats""",
)
def current_year_records_monthly(spark, sf_dir):
    return rounded(P.current_year_records(stats_long(spark, sf_dir, "monthly"), _YEAR))


# No record dates from 1990, so both added columns are empty and go. The columns
# of the daily table hold data at every scale, which SQL has to know beforehand.
@query("drop_empty_stats", f"{DAILY_STATS_LONG}\nSELECT * FROM stats")
def drop_empty_stats(spark, sf_dir):
    stats = P.current_year_records(stats_long(spark, sf_dir), 1990)
    return rounded(P.drop_empty_stats(stats, P.count_filled(stats)))


@query(
    "yesterday_summary",
    f"""{DAILY_HOURLY}
SELECT {_K}, date, round(mid, 6) AS average, round(high, 6) AS high, round(low, 6) AS low
FROM daily WHERE date = DATE '{HOURLY_AS_OF}' - 1 AND good_day AND high IS NOT NULL""",
)
def yesterday_summary(spark, sf_dir):
    return rounded(P.yesterday_summary(daily_hourly(spark, sf_dir), F.lit(HOURLY_AS_OF)))


def _stat_differs(columns: list[str]) -> str:
    return " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in columns)


def _changed_sql(kind: str) -> str:
    axis, columns = ("yearday", DAILY_STATS) if kind == "daily" else ("month", MONTHLY_STATS)
    return f"""{_old_and_new(kind)}
SELECT coalesce(o.station_id, n.station_id) AS station_id,
       bool_or(o.{axis} IS NULL OR n.{axis} IS NULL OR {_stat_differs(columns)}) AS changed
FROM old o FULL JOIN new n ON o.station_id = n.station_id AND o.variable = n.variable
                          AND o.{axis} = n.{axis}
GROUP BY 1"""


@query("stats_changed", _changed_sql("daily"))
def stats_changed(spark, sf_dir):
    return P.stats_changed(stats_before_2001(spark, sf_dir), stats_long(spark, sf_dir))


@query("stats_changed_monthly", _changed_sql("monthly"))
def stats_changed_monthly(spark, sf_dir):
    return P.stats_changed(
        stats_before_2001(spark, sf_dir, "monthly"), stats_long(spark, sf_dir, "monthly")
    )


_UNIT = """CASE variable WHEN 'Water Level' THEN 'ft' ELSE '°F' END"""


def _text(c: str) -> str:
    return f"coalesce(CAST(round_even({c} * 1000.0, 0) / 1000.0 AS VARCHAR), 'nan')"


def _new_records_sql(kind: str) -> str:
    axis, label = ("yearday", "date_label") if kind == "daily" else ("month", "month_label")
    names = record_names(DAILY_STATS if kind == "daily" else MONTHLY_STATS)
    parts = " UNION ALL ".join(
        f"""SELECT n.station_id, n.variable, n.{label}, '{r}' AS record, n.{r} AS value,
            n.{r}_year AS year, o.{r} AS old_value, o.{r}_year AS old_year
            FROM new n LEFT JOIN old o ON o.station_id = n.station_id
              AND o.variable = n.variable AND o.{axis} = n.{axis}"""
        for r in names
    )
    return f"""{_old_and_new(kind)},
rows AS ({parts})
SELECT {_K}, {label}, record, value, year, old_value, old_year,
  CASE WHEN value IS DISTINCT FROM old_value THEN
    upper(record[1]) || replace(record[2:], '_', ' ') || ' of ' || lower(variable) || ' on '
    || {label} || ' is ' || {_text('value')} || ' ' || {_UNIT} || ' (' || year || '), was '
    || {_text('old_value')} || ' ' || {_UNIT} || ' ('
    || coalesce(CAST(old_year AS VARCHAR), 'nan') || ')' END AS message
FROM rows
WHERE value IS NOT NULL
  AND (value IS DISTINCT FROM old_value OR year IS DISTINCT FROM old_year)"""


def _new_records(spark, sf_dir, kind):
    new = stats_long(spark, sf_dir, kind)
    units = station_units(obs_long(spark, sf_dir))
    return rounded(P.new_records(stats_before_2001(spark, sf_dir, kind), new, units))


@query("new_records", _new_records_sql("daily"))
def new_records(spark, sf_dir):
    return _new_records(spark, sf_dir, "daily")


@query("new_records_monthly", _new_records_sql("monthly"))
def new_records_monthly(spark, sf_dir):
    return _new_records(spark, sf_dir, "monthly")


# --- counting ----------------------------------------------------------------


def _counts_sql(prefix: str, columns: list[str]) -> str:
    names = record_names(columns)
    union = " UNION ALL ".join(
        f"SELECT {_K}, '{n}' AS record, {n}_year AS year FROM stats" for n in names
    )
    counts = ", ".join(
        f"CAST(count(CASE WHEN record = '{n}' THEN 1 END) AS INTEGER) AS {n}" for n in names
    )
    return f"""{prefix},
dated AS (SELECT * FROM ({union}) WHERE year IS NOT NULL),
counts AS (SELECT {_K}, year, {counts} FROM dated GROUP BY {_K}, year)"""


def _record_counts_sql(prefix: str, columns: list[str], lo: str, hi: str) -> str:
    names = record_names(columns)
    filled = ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in names)
    return f"""{_counts_sql(prefix, columns)},
axis AS (SELECT {_K}, CAST(unnest(generate_series({lo}, {hi})) AS INTEGER) AS year
         FROM counts GROUP BY {_K}),
filled AS (
  SELECT a.station_id, a.variable, a.year, {filled}
  FROM axis a LEFT JOIN counts c ON c.station_id = a.station_id AND c.variable = a.variable
                                AND c.year = a.year)"""


_COUNTS_DAILY = _record_counts_sql(DAILY_STATS_LONG, DAILY_STATS, "min(year)", "max(year)")
_COUNTS_MONTHLY = _record_counts_sql(MONTHLY_STATS_LONG, MONTHLY_STATS, "min(year)", "max(year)")


@query("record_counts", f"{_COUNTS_DAILY} SELECT * FROM filled")
def record_counts(spark, sf_dir):
    return A.record_counts(stats_long(spark, sf_dir))


@query("record_counts_monthly", f"{_COUNTS_MONTHLY} SELECT * FROM filled")
def record_counts_monthly(spark, sf_dir):
    return A.record_counts(stats_long(spark, sf_dir, "monthly"))


@query(
    "daily_records_set",
    f"{_counts_sql(MONTHLY_STATS_LONG, MONTHLY_STATS)} SELECT * FROM counts",
)
def daily_records_set(spark, sf_dir):
    return A.daily_records_set(stats_long(spark, sf_dir, "monthly"))


@query(
    "daily_records_set_daily",
    f"{_counts_sql(DAILY_STATS_LONG, DAILY_STATS)} SELECT * FROM counts",
)
def daily_records_set_daily(spark, sf_dir):
    return A.daily_records_set(stats_long(spark, sf_dir))


_FIXED = _record_counts_sql(DAILY_STATS_LONG, DAILY_STATS, "min(year)", str(_YEAR))
_SERIES = " UNION ALL ".join(
    f"SELECT {_K}, year, '{n}' AS record, {n} AS n_records FROM filled"
    for n in record_names(DAILY_STATS)
)


@query("annual_record_series", f"{_FIXED} {_SERIES}")
def annual_record_series(spark, sf_dir):
    return A.annual_record_series(stats_long(spark, sf_dir), _YEAR)


def _hits(year: int, columns: list[str]) -> str:
    return " + ".join(
        f"CASE WHEN {n}_year = {year} THEN 1 ELSE 0 END" for n in record_names(columns)
    )


def _this_last_sql(columns: list[str]) -> str:
    return f"""SELECT {_K}, CAST(sum({_hits(_YEAR, columns)}) AS BIGINT) AS this_year,
       CAST(sum({_hits(_YEAR - 1, columns)}) AS BIGINT) AS last_year FROM stats GROUP BY {_K}"""


_THIS_LAST = _this_last_sql(DAILY_STATS)


@query("records_this_and_last_year", f"{DAILY_STATS_LONG}\n{_THIS_LAST}")
def records_this_and_last_year(spark, sf_dir):
    return A.records_this_and_last_year(stats_long(spark, sf_dir), _YEAR)


@query(
    "records_this_and_last_year_monthly",
    f"{MONTHLY_STATS_LONG}\n{_this_last_sql(MONTHLY_STATS)}",
)
def records_this_and_last_year_monthly(spark, sf_dir):
    return A.records_this_and_last_year(stats_long(spark, sf_dir, "monthly"), _YEAR)


def _flags_sql(columns: list[str]) -> str:
    return ", ".join(
        f"coalesce({n}_year = {_YEAR}, false) AS {n}_is_new" for n in record_names(columns)
    )


@query(
    "record_row_flags_monthly",
    f"""{MONTHLY_STATS_LONG}
SELECT {_K}, month, month_label, {_flags_sql(MONTHLY_STATS)} FROM stats""",
)
def record_row_flags_monthly(spark, sf_dir):
    return A.record_row_flags(stats_long(spark, sf_dir, "monthly"), _YEAR)


@query(
    "record_row_flags",
    f"""{DAILY_STATS_LONG}
SELECT {_K}, yearday, date_label, {_flags_sql(DAILY_STATS)} FROM stats""",
)
def record_row_flags(spark, sf_dir):
    return A.record_row_flags(stats_long(spark, sf_dir), _YEAR)


# --- display -----------------------------------------------------------------


def _shown(name: str, kind: str, value: str) -> str:
    """A statistic of `stats` rounded for display."""
    if kind == "years":
        return name
    shown = f"""CASE WHEN variable = 'Water Level' THEN round_even({name} * 100.0, 0) / 100.0
      ELSE round_even({name} * 10.0, 0) / 10.0 END AS {name}"""
    return shown if kind == "avg" else f"{shown}, {name}_year"


@query(
    "stats_table",
    f"""{DAILY_STATS_LONG},
span AS (
  SELECT {_K}, 'Readings of ' || strftime(min(date), '%-m/%-d/%Y') || ' - '
         || strftime(max(date), '%-m/%-d/%Y') AS subtitle
  FROM days GROUP BY {_K})
SELECT * FROM (
  SELECT {_K}, yearday, date_label, {', '.join(_shown(*s) for s in _DAY_STATS)} FROM stats)
LEFT JOIN span USING ({_K})""",
)
def stats_table(spark, sf_dir):
    daily = daily_long(spark, sf_dir)
    return A.stats_table(rounded(daily_stats(daily)), data_range(daily))


@query(
    "stats_table_header",
    f"""{DAILY_STATS_LONG},
counts AS ({_THIS_LAST}),
wanted AS (
  SELECT DISTINCT station_id, unnest(['Water Level', 'Wind Speed']) AS variable FROM obs)
SELECT w.station_id, w.variable,
  coalesce(lower(w.variable) || ', daily records: ' || this_year || ' from this year, '
    || last_year || ' from the year before',
    lower(w.variable) || ': no daily statistics here') AS heading
FROM wanted w LEFT JOIN counts c ON c.station_id = w.station_id AND c.variable = w.variable""",
)
def stats_table_header(spark, sf_dir):
    names = F.array(F.lit(WATER_LEVEL), F.lit("Wind Speed"))
    stations = obs_long(spark, sf_dir).select("station_id").distinct()
    wanted = stations.withColumn("variable", F.explode(names))
    return A.table_header(wanted, stats_long(spark, sf_dir), _YEAR)


@query(
    "today_value",
    f"""{DAILY_STATS_LONG}
SELECT {_K}, date_label,
       coalesce(CAST(round_even(average_high * 10.0, 0) / 10.0 AS VARCHAR), 'nan')
         || ' ' || {_UNIT} AS value
FROM stats WHERE date_label = strftime(DATE '{LONG_AS_OF}', '%d-%b')""",
)
def today_value(spark, sf_dir):
    stats = rounded(stats_long(spark, sf_dir))
    units = station_units(obs_long(spark, sf_dir))
    return A.today_value(stats, units, F.lit(LONG_AS_OF), "average_high")


def _bounds_sql(prefix: str, divisor: int) -> str:
    return f"""{prefix}
SELECT {_K}, round({divisor} * floor(min(record_low) / {divisor}), 6) AS y_min,
       round({divisor} * floor(max(record_high) / {divisor}) + {divisor}, 6) AS y_max
FROM stats GROUP BY {_K}"""


@query("axis_bounds", _bounds_sql(DAILY_STATS_LONG, 10))
def axis_bounds(spark, sf_dir):
    return rounded(A.axis_bounds(stats_long(spark, sf_dir)))


@query("axis_bounds_monthly", _bounds_sql(MONTHLY_STATS_LONG, 1))
def axis_bounds_monthly(spark, sf_dir):
    return rounded(A.axis_bounds(stats_long(spark, sf_dir, "monthly")))


