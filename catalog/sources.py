"""Sources, sinks and jobs: written to the shared folder and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.base import (
    DAILY_LONG,
    DAILY_STATS_LONG,
    HOURLY_AS_OF,
    HOURLY_VARIABLES,
    LONG_AS_OF,
    LONG_DAY,
    LONG_HR,
    MONTHLY_STATS_LONG,
    MONTHS,
    OBS_HOURLY,
    OBS_LONG,
    daily_long,
    daily_sql,
    daily_stats_sql,
    monthly_stats_sql,
    obs_hourly,
    obs_long,
    query,
    r6,
    rounded,
    table,
)
from catalog.combine import HEIGHTS_TO, LEVELS_FROM, SPLICE_SQL, ntz, one_per_time_sql
from catalog.published import stats_long
from tidemark.operators.combine import last_obs, one_per_time
from tidemark.operators.published import yesterday_summary
from tidemark.plans import jobs
from tidemark.plans.store import Store
from tidemark.schemas import KEYS, WATER_LEVEL
from tidemark.shared import fresh_path
from tidemark.sources import metadata as M
from tidemark.sources import observations as O
from tidemark.sources import products as P
from tidemark.sources import stations as S
from tidemark.sources import statistics as T

_K = "station_id, variable"


@query(
    "read_observations",
    f"""WITH {OBS_HOURLY},
masked AS (SELECT *, CASE WHEN flag = '0,0,0' THEN value END AS v FROM obs)
SELECT {_K}, ts, v AS value, qc FROM masked WHERE v IS NOT NULL OR qc IS NOT NULL""",
)
def read_observations(spark, sf_dir):
    """Wide gzip CSV files, written and read back as long observations."""
    rows = obs_hourly(spark, sf_dir, True)
    masked = rows.withColumn("value", F.when(F.col("flag") == "0,0,0", F.col("value")))
    variables = list(HOURLY_VARIABLES.values())
    path = fresh_path(spark, "record-csv")
    O.write_record_csv(masked, path, variables)
    return O.read_record_csv(spark, path, variables)


@query("write_observations", f"WITH {OBS_LONG} SELECT {_K}, ts, value, qc FROM obs")
def write_observations(spark, sf_dir):
    path = fresh_path(spark, "record")
    O.write_observations(obs_long(spark, sf_dir), path)
    return O.read_observations(spark, path)


# --- products ----------------------------------------------------------------


def landed(spark, sf_dir, hourly_span=True) -> dict:
    """`events` in the column layout of each product."""
    ev = obs_hourly(spark, sf_dir, True)
    value, flag = F.col("value"), F.col("flag")

    def of(variable, *columns):
        return ev.where(F.col("variable") == variable).select("station_id", "ts", *columns)

    level_from, height_to = ntz(LEVELS_FROM), ntz(HEIGHTS_TO)
    six = (F.floor(F.minute("ts") / 6) * 6).cast("int")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    level = [value.alias("wlevel"), F.lit(0.1).alias("s"), flag.alias("wlevel_flag")]
    return {
        "air_temperature": of("Air Temperature", value.alias("atemp"), flag.alias("atemp_flag")),
        "water_temperature": of("Water Temperature", value.alias("wtemp"), flag.alias("wtemp_flag")),
        "air_pressure": of("Barometric Pressure", value.alias("apres"), flag.alias("apres_flag")),
        "wind": of(
            "Wind Speed",
            value.alias("windspeed"),
            F.lit(90.0).alias("winddir_deg"),
            F.lit("E").alias("winddir"),
            (value + 1.5).alias("windgust"),
            flag.alias("wind_flag"),
        ),
        "water_level": of(WATER_LEVEL, *level, F.col("qc").alias("wlevel_qc"))
        .where(F.col("ts") >= level_from)
        .withColumn("ts", hour + F.make_dt_interval(mins=six)),
        "hourly_height": of(WATER_LEVEL, *level)
        .where(F.col("ts") < height_to)
        .withColumn("ts", hour),
    }


_PRODUCT_ROWS = f"""rows AS (
  SELECT CASE variable WHEN 'Air Temperature' THEN 'air_temperature'
                       WHEN 'Water Temperature' THEN 'water_temperature'
                       WHEN 'Barometric Pressure' THEN 'air_pressure' ELSE 'wind' END AS product,
         {_K}, ts, value, CAST(NULL AS VARCHAR) AS qc, flag
  FROM obs WHERE variable <> 'Water Level'
  UNION ALL
  SELECT 'wind', station_id, 'Wind Gust', ts, value + 1.5, NULL, flag
  FROM obs WHERE variable = 'Wind Speed'
  UNION ALL
  SELECT 'water_level', {_K},
         date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 6) * 6 AS INTEGER)),
         value, qc, flag
  FROM obs WHERE variable = 'Water Level' AND ts >= TIMESTAMP '{LEVELS_FROM}'
  UNION ALL
  SELECT 'hourly_height', {_K}, date_trunc('hour', ts), value, 'v', flag
  FROM obs WHERE variable = 'Water Level' AND ts < TIMESTAMP '{HEIGHTS_TO}')"""


@query("read_product", f"WITH {OBS_HOURLY},\n{_PRODUCT_ROWS}\nSELECT * FROM rows")
def read_product(spark, sf_dir):
    """All six products, landed as CSV files and read back as long rows."""
    out = None
    for product, frame in landed(spark, sf_dir).items():
        path = fresh_path(spark, product)
        frame.write.option("header", True).option("timestampNTZFormat", O.TIME_FORMAT).csv(path)
        rows = P.read_product(spark, path, product).withColumn("product", F.lit(product))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- stations and metadata ---------------------------------------------------


@query(
    "read_stations",
    """WITH requested AS (SELECT s_name AS station_name FROM supplier
                   UNION ALL SELECT c_name FROM customer),
registry AS (SELECT s_name, CAST(s_suppkey AS VARCHAR) AS station_id FROM supplier)
SELECT q.station_name, r.station_id, r.station_id IS NOT NULL AS known,
       lower(q.station_name) AS station_key, '_' || lower(q.station_name) AS dirname
FROM requested q LEFT JOIN registry r ON r.s_name = q.station_name""",
)
def read_stations(spark, sf_dir):
    """Suppliers as the registry; customers are names it does not know."""
    suppliers = table(spark, sf_dir, "supplier")
    entry = F.to_json(F.create_map("s_name", F.col("s_suppkey").cast("string")))
    path = fresh_path(spark, "registry")
    suppliers.select(entry).write.text(path)
    requested = suppliers.select(F.col("s_name").alias("station_name")).unionByName(
        table(spark, sf_dir, "customer").select(F.col("c_name").alias("station_name"))
    )
    return S.resolve_stations(requested, S.read_stations(spark, path, lines=True))


def station_config(obs):
    """Settings of each station that occurs in the observations."""
    return obs.select("station_id").distinct().select(
        F.concat(F.lit("Port St. "), "station_id", F.lit(", XY")).alias("stationname"),
        "station_id",
        F.lit("english").alias("unit_system"),
        F.lit("lst").alias("tz"),
        F.lit("MHHW").alias("datum"),
    )


@query(
    "read_metadata",
    f"""{DAILY_LONG},
last AS (SELECT {_K}, max(ts) AS last_obs FROM obs WHERE value IS NOT NULL GROUP BY {_K}),
yesterday AS (
  SELECT {_K}, mid, high, low FROM daily
  WHERE date = DATE '{LONG_AS_OF}' - 1 AND good_day AND high IS NOT NULL)
SELECT l.station_id, l.variable, 'Port St. ' || l.station_id || ', XY' AS stationname,
       '_portSt' || upper(l.station_id) || 'Xy' AS dirname, 'english' AS unit_system,
       'lst' AS tz, 'MHHW' AS datum, {LONG_HR} AS hr_threshold, {LONG_DAY} AS day_threshold,
       CASE l.variable WHEN 'Water Level' THEN 'ft' ELSE '°F' END AS unit, l.last_obs,
       round(y.mid, 6) AS yesterday_average, round(y.high, 6) AS yesterday_high,
       round(y.low, 6) AS yesterday_low
FROM last l LEFT JOIN yesterday y ON y.station_id = l.station_id AND y.variable = l.variable""",
)
def read_metadata(spark, sf_dir):
    """Metadata built from the record, written and read back."""
    obs = obs_long(spark, sf_dir)
    yesterday = yesterday_summary(daily_long(spark, sf_dir), F.lit(LONG_AS_OF))
    built = M.build_metadata(station_config(obs), last_obs(obs), yesterday, LONG_HR, LONG_DAY)
    path = fresh_path(spark, "metadata")
    M.write_metadata(built, path)
    return rounded(M.metadata_rows(M.read_metadata(spark, path)))


def _stats_round_trip(spark, sf_dir, kind):
    path = fresh_path(spark, f"{kind}-stats")
    T.write_stats(stats_long(spark, sf_dir, kind), path, kind)
    return rounded(T.read_stats(spark, path, kind))


@query("write_stats", f"{DAILY_STATS_LONG}\nSELECT * FROM stats")
def write_stats(spark, sf_dir):
    return _stats_round_trip(spark, sf_dir, "daily")


@query("write_stats_monthly", f"{MONTHLY_STATS_LONG}\nSELECT * FROM stats")
def write_stats_monthly(spark, sf_dir):
    return _stats_round_trip(spark, sf_dir, "monthly")


# --- jobs --------------------------------------------------------------------


def _store(spark) -> Store:
    return Store(spark, fresh_path(spark, "store"))


_AS_OF = date.fromisoformat(HOURLY_AS_OF)

_LOADED = f"""{_PRODUCT_ROWS},
{SPLICE_SQL},
record AS (
  SELECT {_K}, ts, CASE WHEN flag = '0,0,0' THEN value END AS value, qc FROM rows
  WHERE product NOT IN ('hourly_height', 'water_level')
  UNION ALL SELECT {_K}, ts, value, qc FROM spliced)"""
# Here the levels are masked before the splice.
_LOADED = _LOADED.replace(
    "value, qc\n  FROM obs WHERE variable = 'Water Level' AND ts >=",
    "CASE WHEN flag = '0,0,0' THEN value END AS value, qc\n"
    "  FROM obs WHERE variable = 'Water Level' AND ts >=",
)


@query("initial_load", f"WITH {OBS_HOURLY},\n{_LOADED}\nSELECT * FROM record")
def initial_load(spark, sf_dir):
    """Six landed products to a stored record."""
    frames = landed(spark, sf_dir)
    record = jobs.combine_products(
        {name: P.normalise_product(frame, name) for name, frame in frames.items()}
    )
    store = _store(spark)
    jobs.initial_load(store, record, station_config(obs_hourly(spark, sf_dir)), _AS_OF)
    return store.observations()


def _refreshed(spark, sf_dir) -> Store:
    """Load up to 22 Jan, then refresh from 15 Jan on with verified levels."""
    obs = obs_hourly(spark, sf_dir)
    store = _store(spark)
    before = obs.where(F.col("ts") < ntz("2024-01-22"))
    jobs.initial_load(store, before, station_config(obs), _AS_OF)
    level = F.col("variable") == WATER_LEVEL
    batch = obs.where(F.col("ts") >= ntz("2024-01-15")).withColumns(
        {
            "value": F.when(~level, F.col("value")).when(F.col("value") >= 5, F.col("value") + 1),
            "qc": F.when(level, "v"),
        }
    )
    jobs.update_data(store, batch, _AS_OF)
    return store


_REFRESHED = f"""refreshed AS (
  SELECT {_K}, ts,
    CASE WHEN variable <> 'Water Level' OR ts < TIMESTAMP '2024-01-20' THEN value
         WHEN value >= 5 THEN value + 1
         WHEN ts < TIMESTAMP '2024-01-22' THEN value END AS value,
    CASE WHEN variable = 'Water Level' THEN 'v' END AS qc
  FROM obs)"""


@query("update_data", f"WITH {OBS_HOURLY},\n{_REFRESHED}\nSELECT * FROM refreshed")
def update_data(spark, sf_dir):
    return _refreshed(spark, sf_dir).observations()


# Water levels land as preliminary, missing verified and, from 50 up, verified readings.
_MIXED = f"""WITH {OBS_HOURLY}
SELECT {_K}, ts,
  CASE WHEN variable <> 'Water Level' OR ts < TIMESTAMP '2024-01-20' THEN value
       WHEN value >= 50 THEN value + 1 ELSE value - 40 END AS value,
  CASE WHEN variable = 'Water Level' THEN 'v' END AS qc
FROM obs"""


def _mixed_readings(spark, sf_dir):
    """A loaded store, late readings of other variables, and levels in several readings."""
    obs = obs_hourly(spark, sf_dir)
    store = _store(spark)
    jobs.initial_load(store, obs.where(F.col("ts") < ntz("2024-01-22")), station_config(obs), _AS_OF)
    level = F.col("variable") == WATER_LEVEL
    late = obs.where(F.col("ts") >= ntz("2024-01-15"))

    def of(value, qc):
        return F.struct(value.cast("double").alias("value"), F.lit(qc).alias("qc"))

    two = F.array(of(F.col("value") - 40, "p"), of(F.lit(None), "v"))
    three = F.array_append(two, of(F.col("value") + 1, "v"))
    readings = F.when(F.col("value") >= 50, three).otherwise(two)
    return store, late.where(~level), late.where(level).select(*KEYS, "ts", F.inline(readings))


@query("update_data_mixed_batch", _MIXED)
def update_data_mixed_batch(spark, sf_dir):
    """A refresh with preliminary, verified and missing readings of one time."""
    store, others, levels = _mixed_readings(spark, sf_dir)
    jobs.update_data(store, others.unionByName(levels), _AS_OF)
    return store.observations()


@query("update_data_two_landings", _MIXED)
def update_data_two_landings(spark, sf_dir):
    """The same readings, the preliminary ones first, and the second landing twice."""
    store, others, levels = _mixed_readings(spark, sf_dir)
    verified = F.col("qc") == "v"
    jobs.update_data(store, others.unionByName(levels.where(~verified)), _AS_OF, source="levels", batch_id=0)
    for _ in range(2):
        jobs.update_data(store, levels.where(verified), _AS_OF, source="levels", batch_id=1)
    return store.observations()


@query(
    "update_data_daily",
    f"""WITH {OBS_HOURLY},
{_REFRESHED},
{daily_sql(4, 2, 'refreshed')}
SELECT {_K}, date, {r6('high', 'low', 'mean', 'mid')}, n_hours, preliminary, last_obs FROM daily""",
)
def update_data_daily(spark, sf_dir):
    """The stored daily summaries after a refresh."""
    return rounded(_refreshed(spark, sf_dir).daily())


# One reading per time: the record keeps the lowest.
_SINGLE = f"""WITH {OBS_LONG},
single AS (SELECT {_K}, ts, value, qc FROM obs
           QUALIFY row_number() OVER (PARTITION BY {_K}, ts ORDER BY value, qc) = 1),
{daily_sql(LONG_HR, LONG_DAY, 'single')}"""


def _long_store(spark, sf_dir) -> tuple[Store, dict]:
    """Load up to 2000, refresh with 2001, update the statistics."""
    single = one_per_time(obs_long(spark, sf_dir)).select(*KEYS, "ts", "value", "qc")
    store = _store(spark)
    as_of = date.fromisoformat(LONG_AS_OF)
    old = single.where(F.col("ts") < ntz("2001-01-01"))
    jobs.initial_load(store, old, station_config(single), as_of, LONG_HR, LONG_DAY)
    jobs.update_data(store, single.where(F.col("ts") >= ntz("2000-12-01")), as_of)
    return store, jobs.update_stats(store)


@query("update_data_late_product", f"{_SINGLE}\nSELECT {_K}, ts, value, qc FROM single")
def update_data_late_product(spark, sf_dir):
    """Water levels land first, the other variables of the same times later."""
    single = one_per_time(obs_long(spark, sf_dir)).select(*KEYS, "ts", "value", "qc")
    store = _store(spark)
    as_of = date.fromisoformat(LONG_AS_OF)
    old = single.where(F.col("ts") < ntz("2001-01-01"))
    jobs.initial_load(store, old, station_config(single), as_of, LONG_HR, LONG_DAY)
    level = F.col("variable") == WATER_LEVEL
    batch = single.where(F.col("ts") >= ntz("2000-12-01"))
    jobs.update_data(store, batch.where(level), as_of)
    jobs.update_data(store, batch.where(~level), as_of)
    return store.observations()


@query(
    "initial_load_duplicates",
    f"""WITH {OBS_LONG},
every AS (
  SELECT {_K}, ts, value, qc FROM obs
  UNION ALL SELECT {_K}, ts, value - 100, 'p' FROM obs WHERE variable = 'Water Level'
  UNION ALL SELECT {_K}, ts, NULL, 'v' FROM obs WHERE variable = 'Water Level'
    AND ts < TIMESTAMP '1998-01-01')
{one_per_time_sql('every')}""",
)
def initial_load_duplicates(spark, sf_dir):
    """A first load of several readings of one time."""
    obs = obs_long(spark, sf_dir)
    levels = obs.where(F.col("variable") == WATER_LEVEL)
    lower = levels.withColumns({"value": F.col("value") - 100, "qc": F.lit("p")})
    missing = levels.where(F.col("ts") < ntz("1998-01-01"))
    missing = missing.withColumns({"value": F.lit(None).cast("double"), "qc": F.lit("v")})
    store = _store(spark)
    every = obs.unionByName(lower).unionByName(missing)
    jobs.initial_load(store, every, station_config(obs), date.fromisoformat(LONG_AS_OF), LONG_HR, LONG_DAY)
    return store.observations()


@query("update_stats", f"{daily_stats_sql(_SINGLE)}\nSELECT * FROM stats")
def update_stats(spark, sf_dir):
    store, _ = _long_store(spark, sf_dir)
    return rounded(store.stats("daily"))


@query("update_stats_monthly", f"{monthly_stats_sql(_SINGLE)}\nSELECT * FROM stats")
def update_stats_monthly(spark, sf_dir):
    store, _ = _long_store(spark, sf_dir)
    return rounded(store.stats("monthly"))


@query(
    "reprocess",
    f"{daily_stats_sql(f'WITH {OBS_HOURLY}, {daily_sql(1, 2)}')}\nSELECT * FROM stats",
)
def reprocess(spark, sf_dir):
    """Load with the default gates, then allow only one missing hour."""
    obs = obs_hourly(spark, sf_dir)
    store = _store(spark)
    jobs.initial_load(store, obs, station_config(obs), _AS_OF)
    jobs.reprocess(store, hr_threshold=1, day_threshold=2)
    return rounded(store.stats("daily"))


@query(
    "reprocess_monthly",
    f"{monthly_stats_sql(f'WITH {OBS_HOURLY}, {daily_sql(4, 29)}')}\nSELECT * FROM stats",
)
def reprocess_monthly(spark, sf_dir):
    """Load with the default gates, then allow all but two days of a month to be bad."""
    obs = obs_hourly(spark, sf_dir)
    store = _store(spark)
    jobs.initial_load(store, obs, station_config(obs), _AS_OF)
    jobs.reprocess(store, hr_threshold=4, day_threshold=29)
    return rounded(store.stats("monthly"))


@query(
    "update_stats_ranges",
    f"""{_SINGLE},
{MONTHS},
ranges AS (
  SELECT {_K}, 'daily' AS kind, min(date) AS start_date, max(date) AS end_date
  FROM daily WHERE good_day AND high IS NOT NULL GROUP BY {_K}
  UNION ALL SELECT {_K}, 'monthly', min(first_date), max(last_date) FROM months GROUP BY {_K})
SELECT *, CASE variable WHEN 'Water Level' THEN 'ft' ELSE '°F' END AS unit FROM ranges""",
)
def update_stats_ranges(spark, sf_dir):
    """Data range and unit as kept with the statistics, after a refresh."""
    store, _ = _long_store(spark, sf_dir)
    return store.ranges()
