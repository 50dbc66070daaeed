"""Column expressions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import OBS_HOURLY, OBS_LONG, obs_hourly, obs_long, query, rounded, table, yearday_sql
from tidemark.functions import calendar as C
from tidemark.functions import scalars as S

_FLAG_SUM = "list_sum([CAST(x AS INTEGER) FOR x IN string_split(flag, ',')])"


@query(
    "flag_sum",
    f"WITH {OBS_HOURLY} SELECT event_id, flag, CAST({_FLAG_SUM} AS INTEGER) AS flag_sum FROM obs",
)
def flag_sum(spark, sf_dir):
    return obs_hourly(spark, sf_dir, True).select(
        "event_id", "flag", S.flag_sum("flag").alias("flag_sum")
    )


@query(
    "mask_flagged",
    f"""WITH {OBS_HOURLY}
SELECT event_id, ts, CASE WHEN {_FLAG_SUM} > 0 THEN NULL ELSE value END AS value, qc FROM obs""",
)
def mask_flagged(spark, sf_dir):
    return obs_hourly(spark, sf_dir, True).select(
        "event_id", "ts", S.mask_flagged("value", "flag").alias("value"), "qc"
    )


@query(
    "mask_flagged_row",
    f"""WITH {OBS_HOURLY}
SELECT event_id, variable, ts,
       CASE WHEN {_FLAG_SUM} > 0 THEN NULL ELSE value END AS value,
       CASE WHEN {_FLAG_SUM} > 0 THEN NULL ELSE flag END AS flag,
       CASE WHEN {_FLAG_SUM} > 0 THEN NULL ELSE qc END AS qc FROM obs""",
)
def mask_flagged_row(spark, sf_dir):
    rows = obs_hourly(spark, sf_dir, True).drop("station_id")
    return S.mask_flagged_row(rows, "flag", ["event_id", "variable", "ts"])


@query(
    "null_fill_value",
    f"""WITH {OBS_LONG}
SELECT station_id, variable, ts, nullif(value, 31.8) AS value,
       CASE WHEN variable = 'Water Level' THEN value ELSE nullif(value, 31.8) END
         AS temperature_only
FROM obs""",
)
def null_fill_value(spark, sf_dir):
    temperatures = ["Air Temperature", "Water Temperature"]
    return obs_long(spark, sf_dir).select(
        "station_id",
        "variable",
        "ts",
        S.null_fill_value("value").alias("value"),
        S.null_fill_value("value", variable="variable", variables=temperatures).alias(
            "temperature_only"
        ),
    )


@query(
    "yearday366",
    f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
       {yearday_sql('o_orderdate')} AS yearday FROM orders""",
)
def yearday366(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("date"),
        C.yearday366("o_orderdate").alias("yearday"),
    )


@query(
    "day_label",
    f"""SELECT o_orderkey, strftime(DATE '2019-12-31' + {yearday_sql('o_orderdate')}, '%d-%b')
       AS date_label FROM orders""",
)
def day_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", C.day_label(C.yearday366("o_orderdate")).alias("date_label")
    )


@query("month_label", "SELECT o_orderkey, strftime(o_orderdate, '%b') AS month_label FROM orders")
def month_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", C.month_label(F.month("o_orderdate")).alias("month_label")
    )


@query("format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def format_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", C.format_date("o_orderdate").alias("day")
    )


@query(
    "format_range",
    """SELECT o_custkey,
       strftime(min(o_orderdate), '%-m/%-d/%Y') || ' - ' || strftime(max(o_orderdate), '%-m/%-d/%Y')
         AS span
FROM orders GROUP BY o_custkey""",
)
def format_range(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    return spans.select("o_custkey", C.format_range("a", "b").alias("span"))


@query(
    "unit_for",
    f"""WITH {OBS_HOURLY}
SELECT event_id, variable,
  CASE variable
    WHEN 'Air Temperature' THEN CASE WHEN value < 10 THEN '°C' ELSE '°F' END
    WHEN 'Water Temperature' THEN CASE WHEN value < 10 THEN '°C' ELSE '°F' END
    WHEN 'Barometric Pressure' THEN 'mb'
    WHEN 'Wind Speed' THEN CASE WHEN value < 10 THEN 'm/s' ELSE 'kn' END
    WHEN 'Water Level' THEN CASE WHEN value < 10 THEN 'm' ELSE 'ft' END
  END AS unit
FROM obs""",
)
def unit_for(spark, sf_dir):
    system = F.when(F.col("value") < 10, "metric").otherwise("English")
    return obs_hourly(spark, sf_dir, True).select(
        "event_id", "variable", S.unit_for("variable", system).alias("unit")
    )


@query(
    "station_key",
    r"""WITH named AS (
  SELECT p_partkey, p_name || ', St. ' || p_type || '_' || p_brand AS station_name FROM part),
split AS (
  SELECT *, string_split(trim(regexp_replace(
      translate(regexp_replace(station_name, '[,.]', '', 'g'), '-_', '  '), '\s+', ' ', 'g')), ' ')
    AS w FROM named)
SELECT p_partkey, station_name,
  lower(w[1]) || array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN w[2:]], '') AS station_key
FROM split""",
)
def station_key(spark, sf_dir):
    name = F.concat("p_name", F.lit(", St. "), "p_type", F.lit("_"), "p_brand")
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("station_name"))
    return parts.withColumn("station_key", S.station_key("station_name"))


@query(
    "validate_config",
    """WITH config AS (
  SELECT o_orderkey,
    CASE o_orderstatus WHEN 'O' THEN 'Metric' WHEN 'F' THEN 'ENGLISH' ELSE 'imperial' END
      AS unit_system,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'GMT' WHEN o_orderpriority = '2-HIGH' THEN 'lst'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'lst_ldt' ELSE 'utc' END AS tz,
    CASE WHEN o_totalprice < 100000 THEN 'mhhw' WHEN o_totalprice < 300000 THEN 'NAVD'
         ELSE 'NGVD' END AS datum
  FROM orders)
SELECT *, valid_units AND valid_tz AND valid_datum AS valid FROM (
  SELECT *, lower(unit_system) IN ('metric', 'english') AS valid_units,
    lower(tz) IN ('gmt', 'lst', 'lst_ldt') AS valid_tz,
    upper(datum) IN ('STND', 'MHHW', 'MHW', 'MTL', 'MSL', 'MLW', 'MLLW', 'NAVD') AS valid_datum
  FROM config)""",
)
def validate_config(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    config = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "O", "Metric")
        .when(status == "F", "ENGLISH")
        .otherwise("imperial")
        .alias("unit_system"),
        F.when(priority == "1-URGENT", "GMT")
        .when(priority == "2-HIGH", "lst")
        .when(priority == "3-MEDIUM", "lst_ldt")
        .otherwise("utc")
        .alias("tz"),
        F.when(F.col("o_totalprice") < 100000, "mhhw")
        .when(F.col("o_totalprice") < 300000, "NAVD")
        .otherwise("NGVD")
        .alias("datum"),
    )
    return S.validate_config(config)


@query(
    "round_down",
    """SELECT c_custkey, round(10 * floor(c_acctbal / 10), 6) AS tens FROM customer""",
)
def round_down(spark, sf_dir):
    return rounded(
        table(spark, sf_dir, "customer").select(
            "c_custkey", S.round_down("c_acctbal", 10).alias("tens")
        )
    )


@query(
    "round_up",
    """SELECT c_custkey, round(10 * floor(c_acctbal / 10) + 10, 6) AS tens FROM customer""",
)
def round_up(spark, sf_dir):
    return rounded(
        table(spark, sf_dir, "customer").select(
            "c_custkey", S.round_up("c_acctbal", 10).alias("tens")
        )
    )


@query(
    "round_stat",
    f"""WITH {OBS_HOURLY}
SELECT event_id, variable,
       CASE WHEN variable = 'Water Level' THEN round_even(value / 8 * 100.0, 0) / 100.0
            ELSE round_even(value / 8 * 10.0, 0) / 10.0 END AS shown
FROM obs""",
)
def round_stat(spark, sf_dir):
    return obs_hourly(spark, sf_dir, True).select(
        "event_id", "variable", S.round_stat("variable", F.col("value") / 8).alias("shown")
    )
