"""Registry, the test tables as observations, and shared SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import daily_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can say it, the text it must match."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles to a fixed number of places: sums have no fixed order."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, {decimals}) AS `{f.name}`"
            if isinstance(f.dataType, T.DoubleType)
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def r6(*columns: str) -> str:
    """SQL list of columns rounded like `rounded`."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# --- lineitem: seven years of daily readings at two stations -----------------

LONG_VARIABLES = {"A": "Air Temperature", "N": "Water Temperature", "R": "Water Level"}
LONG_AS_OF = "2001-06-15"
LONG_HR, LONG_DAY = 23, 2


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as observations; quantity 32 stands for the fill value."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    variable = F.when(flag == "A", "Air Temperature").when(flag == "N", "Water Temperature")
    qc = F.when(F.col("l_shipdate") >= F.lit("2001-07-01").cast("timestamp_ntz"), "p").otherwise("v")
    return li.select(
        F.col("l_linestatus").alias("station_id"),
        variable.otherwise("Water Level").alias("variable"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("l_quantity") == 32, 31.8).otherwise(F.col("l_quantity")).alias("value"),
        F.when(flag == "R", qc).alias("qc"),
    )


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_table(obs_long(spark, sf_dir), LONG_HR, LONG_DAY)


OBS_LONG = """obs AS (
  SELECT l_linestatus AS station_id,
         CASE l_returnflag WHEN 'A' THEN 'Air Temperature'
                           WHEN 'N' THEN 'Water Temperature'
                           ELSE 'Water Level' END AS variable,
         l_shipdate AS ts,
         CASE WHEN l_quantity = 32 THEN 31.8 ELSE l_quantity END AS value,
         CASE WHEN l_returnflag <> 'R' THEN NULL
              WHEN l_shipdate >= TIMESTAMP '2001-07-01' THEN 'p' ELSE 'v' END AS qc
  FROM lineitem)"""

# --- events: a month of readings at one station ------------------------------

HOURLY_VARIABLES = {
    "click": "Air Temperature",
    "view": "Water Temperature",
    "purchase": "Barometric Pressure",
    "signup": "Wind Speed",
    "error": "Water Level",
}
HOURLY_AS_OF = "2024-01-20"


def obs_hourly(spark: SparkSession, sf_dir: str, flagged: bool = False) -> DataFrame:
    """`events` as observations, with the flag column if asked for.

    Readings from 200 up and below 1 carry flags.
    """
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    variable = F.create_map(*[F.lit(x) for pair in HOURLY_VARIABLES.items() for x in pair])[kind]
    ts = F.col("ts").cast("timestamp_ntz")
    qc = F.when(ts >= F.lit("2024-01-20").cast("timestamp_ntz"), "p").otherwise("v")
    flag = F.when(F.col("value") >= 200, "1,0,0").when(F.col("value") < 1, "0,1,1")
    columns = [
        F.lit("ALL").alias("station_id"),
        variable.alias("variable"),
        ts.alias("ts"),
        F.col("value"),
        F.when(kind == "error", qc).alias("qc"),
    ]
    if flagged:
        columns += [F.col("event_id"), flag.otherwise("0,0,0").alias("flag")]
    return ev.select(*columns)


def daily_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_table(obs_hourly(spark, sf_dir))


OBS_HOURLY = """obs AS (
  SELECT 'ALL' AS station_id,
         CASE event_type WHEN 'click' THEN 'Air Temperature'
                         WHEN 'view' THEN 'Water Temperature'
                         WHEN 'purchase' THEN 'Barometric Pressure'
                         WHEN 'signup' THEN 'Wind Speed'
                         WHEN 'error' THEN 'Water Level' END AS variable,
         ts, value,
         CASE WHEN event_type <> 'error' THEN NULL
              WHEN ts >= TIMESTAMP '2024-01-20' THEN 'p' ELSE 'v' END AS qc,
         event_id,
         CASE WHEN value >= 200 THEN '1,0,0'
              WHEN value < 1 THEN '0,1,1' ELSE '0,0,0' END AS flag
  FROM events)"""

# --- shared steps ------------------------------------------------------------


def daily_sql(hr: int, day: int, source: str = "obs") -> str:
    """Gated daily table `daily` from observations."""
    return f"""daily0 AS (
  SELECT station_id, variable, CAST(ts AS DATE) AS date,
         max(v) AS high, min(v) AS low, avg(v) AS mean, (max(v) + min(v)) / 2 AS mid,
         CAST(count(DISTINCT CASE WHEN v IS NOT NULL THEN hour(ts) END) AS INTEGER) AS n_hours,
         bool_or(coalesce(qc = 'p', false)) AS preliminary,
         max(CASE WHEN value IS NOT NULL THEN ts END) AS last_obs
  FROM (SELECT *, nullif(value, 31.8) AS v FROM {source})
  GROUP BY station_id, variable, CAST(ts AS DATE)),
daily AS (
  SELECT *, n_hours >= {24 - hr} AS good_day,
         sum(CASE WHEN n_hours >= {24 - hr} AND high IS NOT NULL THEN 1 ELSE 0 END)
           OVER (PARTITION BY station_id, variable, date_trunc('month', date))
           >= day(last_day(date)) - {day} AS good_month
  FROM daily0)"""


DAILY_LONG = f"WITH {OBS_LONG},\n{daily_sql(LONG_HR, LONG_DAY)}"
DAILY_HOURLY = f"WITH {OBS_HOURLY},\n{daily_sql(4, 2)}"

YEARDAY = """CAST(dayofyear({d}) + CASE WHEN month({d}) > 2 AND
  day(last_day(make_date(year({d}), 2, 1))) = 28 THEN 1 ELSE 0 END AS INTEGER)"""


def yearday_sql(d: str) -> str:
    return YEARDAY.format(d=d)


DAYS = f"""days AS (
  SELECT station_id, variable, date, high, low, mid, mean,
         {yearday_sql('date')} AS yearday, CAST(year(date) AS INTEGER) AS year
  FROM daily WHERE good_day AND high IS NOT NULL)"""

MONTHS = """months AS (
  SELECT station_id, variable, CAST(date_trunc('month', date) AS DATE) AS month_start,
         avg(mid) AS mean, max(mid) AS high, min(mid) AS low,
         min(date) AS first_date, max(date) AS last_date
  FROM daily WHERE good_day AND good_month AND high IS NOT NULL
  GROUP BY station_id, variable, date_trunc('month', date)),
monthly AS (
  SELECT *, CAST(month(month_start) AS INTEGER) AS month,
         CAST(year(month_start) AS INTEGER) AS year FROM months)"""

_DAY_STATS = [
    ("daily_average", "avg", "mid"),
    ("record_high_daily_average", "max", "mid"),
    ("record_low_daily_average", "min", "mid"),
    ("average_high", "avg", "high"),
    ("lowest_high", "min", "high"),
    ("record_high", "max", "high"),
    ("average_low", "avg", "low"),
    ("highest_low", "max", "low"),
    ("record_low", "min", "low"),
    ("years", "years", "year"),
]
_MONTH_STATS = [
    ("monthly_average", "avg", "mean"),
    ("record_high_monthly_average", "max", "mean"),
    ("record_low_monthly_average", "min", "mean"),
] + _DAY_STATS[3:]


def stat_sql(name: str, kind: str, value: str) -> str:
    """One statistic over `marked` rows (see `marked_sql`)."""
    if kind == "avg":
        return f"round(avg({value}), 6) AS {name}"
    if kind == "years":
        return f"CAST(count(DISTINCT {value}) AS INTEGER) AS {name}"
    return (
        f"round({kind}({value}), 6) AS {name}, "
        f"min(CASE WHEN {value} = {kind}_{value} THEN year END) AS {name}_year"
    )


def marked_sql(source: str, axis: str, values: list[str]) -> str:
    """Rows with the extremes of their group beside them."""
    extremes = ", ".join(
        f"{k}({v}) OVER (PARTITION BY station_id, variable, {axis}) AS {k}_{v}"
        for v in values
        for k in ("max", "min")
    )
    return f"marked AS (SELECT *, {extremes} FROM {source})"


def _grouped(stats, source: str, axis: str, values: list[str]) -> str:
    columns = ",\n         ".join(stat_sql(*s) for s in stats)
    return f"""{marked_sql(source, axis, values)},
grouped AS (
  SELECT station_id, variable, {axis},
         {columns}
  FROM marked GROUP BY station_id, variable, {axis})"""


def _spine(axis: str, label: str, length: int, label_expr: str) -> str:
    return f"""stats AS (
  SELECT k.station_id, k.variable, CAST(s.i AS INTEGER) AS {axis}, {label_expr} AS {label},
         g.* EXCLUDE (station_id, variable, {axis})
  FROM (SELECT DISTINCT station_id, variable FROM daily) k
  CROSS JOIN generate_series(1, {length}) AS s(i)
  LEFT JOIN grouped g ON g.station_id = k.station_id AND g.variable = k.variable
                      AND g.{axis} = s.i)"""


_DAY_LABEL = "strftime(DATE '2019-12-31' + CAST(s.i AS INTEGER), '%d-%b')"
_MONTH_LABEL = "strftime(make_date(2020, CAST(s.i AS INTEGER), 1), '%b')"


def daily_stats_sql(prefix: str = DAILY_LONG) -> str:
    """CTEs up to the published daily table `stats`."""
    grouped = _grouped(_DAY_STATS, "days", "yearday", ["mid", "high", "low"])
    return f"{prefix},\n{DAYS},\n{grouped},\n" + _spine("yearday", "date_label", 366, _DAY_LABEL)


def monthly_stats_sql(prefix: str = DAILY_LONG) -> str:
    """CTEs up to the published monthly table `stats`."""
    grouped = _grouped(_MONTH_STATS, "monthly", "month", ["mean", "high", "low"])
    return f"{prefix},\n{MONTHS},\n{grouped},\n" + _spine("month", "month_label", 12, _MONTH_LABEL)


DAILY_STATS_LONG = daily_stats_sql()
MONTHLY_STATS_LONG = monthly_stats_sql()
