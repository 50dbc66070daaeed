"""Putting observation series together."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    HOURLY_VARIABLES,
    LONG_AS_OF,
    OBS_HOURLY,
    OBS_LONG,
    obs_hourly,
    obs_long,
    query,
    table,
)
from tidemark.operators import combine as C
from tidemark.schemas import KEYS, WATER_LEVEL
from tidemark.shared import fresh_path
from tidemark.sources import observations as O

_K = "station_id, variable"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


_WIDE = ",\n       ".join(
    f"min(CASE WHEN variable = '{v}' THEN value END) AS \"{v}\"" for v in HOURLY_VARIABLES.values()
)


@query(
    "assemble_variables",
    f"""WITH {OBS_HOURLY}
SELECT station_id, ts, {_WIDE},
       min(CASE WHEN variable = 'Water Level' THEN qc END) AS "Water Level QC"
FROM obs GROUP BY station_id, ts""",
)
def assemble_variables(spark, sf_dir):
    return C.assemble_variables(obs_hourly(spark, sf_dir), list(HOURLY_VARIABLES.values()))


def one_per_time_sql(source: str) -> str:
    """A value that is there before others, then a verified one, then the lowest; the verified mark."""
    return f"""SELECT {_K}, ts,
    (list(value ORDER BY value IS NULL, qc IS DISTINCT FROM 'v', value))[1] AS value,
    (list(qc ORDER BY qc IS DISTINCT FROM 'v', qc IS NULL, qc))[1] AS qc
  FROM {source} GROUP BY {_K}, ts"""


# Six-minute levels start on 10 Jan; hourly heights run on to 14 Jan.
LEVELS_FROM, HEIGHTS_TO = "2024-01-10", "2024-01-14"


def water_levels(spark, sf_dir):
    """Water level events from 10 Jan on, at six-minute times."""
    six = (F.floor(F.minute("ts") / 6) * 6).cast("int")
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(mins=six)
    rows = obs_hourly(spark, sf_dir).where(
        (F.col("variable") == WATER_LEVEL) & (F.col("ts") >= ntz(LEVELS_FROM))
    )
    return rows.withColumn("ts", at)


def hourly_heights(spark, sf_dir):
    """Water level events up to 14 Jan at full hours; suspect ones are missing."""
    rows = obs_hourly(spark, sf_dir, True).where(
        (F.col("variable") == WATER_LEVEL) & (F.col("ts") < ntz(HEIGHTS_TO))
    )
    ok = F.col("flag") == "0,0,0"
    return rows.select(
        *KEYS,
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.when(ok, F.col("value")).alias("value"),
        F.when(ok, F.lit("v")).alias("qc"),
    )


SPLICE_SQL = f"""levels AS (
  SELECT {_K}, date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 6) * 6 AS INTEGER)) AS ts,
         value, qc
  FROM obs WHERE variable = 'Water Level' AND ts >= TIMESTAMP '{LEVELS_FROM}'),
heights AS (
  SELECT {_K}, date_trunc('hour', ts) AS ts,
         CASE WHEN flag = '0,0,0' THEN value END AS value,
         CASE WHEN flag = '0,0,0' THEN 'v' END AS qc
  FROM obs WHERE variable = 'Water Level' AND ts < TIMESTAMP '{HEIGHTS_TO}'),
first_level AS (SELECT {_K}, min(ts) AS t FROM levels GROUP BY {_K}),
in_range AS (
  SELECT h.* FROM heights h LEFT JOIN first_level f
    ON f.station_id = h.station_id AND f.variable = h.variable
  WHERE f.t IS NULL OR CAST(h.ts AS DATE) <= CAST(f.t AS DATE) + 1),
older AS (
  SELECT * FROM in_range QUALIFY ts < max(ts) OVER (PARTITION BY {_K})),
sides AS (
  SELECT * FROM (SELECT *, 0 AS src FROM older UNION ALL SELECT *, 1 AS src FROM levels)
  QUALIFY src = min(src) OVER (PARTITION BY {_K}, ts)),
spliced AS ({one_per_time_sql('sides')})"""


@query("splice_hourly", f"WITH {OBS_HOURLY},\n{SPLICE_SQL}\nSELECT * FROM spliced")
def splice_hourly(spark, sf_dir):
    return C.splice_hourly(hourly_heights(spark, sf_dir), water_levels(spark, sf_dir))


def verified_long(spark, sf_dir):
    """Second reading of water levels from May 2001 on: shifted, some missing."""
    rows = obs_long(spark, sf_dir).where(
        (F.col("variable") == WATER_LEVEL) & (F.col("ts") >= ntz("2001-05-01"))
    )
    return rows.withColumns(
        {
            "value": F.when(F.col("value") < 45, F.col("value") + 0.5),
            "qc": F.lit("v"),
        }
    )


@query(
    "overlay_verified",
    f"""WITH {OBS_LONG},
fresh AS (
  SELECT {_K}, ts, CASE WHEN value < 45 THEN value + 0.5 END AS value, 'v' AS qc
  FROM obs WHERE variable = 'Water Level' AND ts >= TIMESTAMP '2001-05-01'),
span AS (
  SELECT {_K}, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) + 1 AS b
  FROM obs WHERE qc = 'p' GROUP BY {_K}),
inside AS (
  {one_per_time_sql("""(SELECT f.* FROM fresh f JOIN span s ON s.station_id = f.station_id
    AND s.variable = f.variable WHERE CAST(f.ts AS DATE) BETWEEN s.a AND s.b)""")})
SELECT o.station_id, o.variable, o.ts, coalesce(i.value, o.value) AS value,
       coalesce(i.qc, o.qc) AS qc
FROM obs o LEFT JOIN inside i
  ON i.station_id = o.station_id AND i.variable = o.variable AND i.ts = o.ts""",
)
def overlay_verified(spark, sf_dir):
    return C.overlay_verified(obs_long(spark, sf_dir), verified_long(spark, sf_dir))


@query(
    "preliminary_range",
    f"""WITH {OBS_LONG}
SELECT {_K}, CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) + 1 AS end_date
FROM obs WHERE qc = 'p' GROUP BY {_K}""",
)
def preliminary_range(spark, sf_dir):
    return C.preliminary_range(obs_long(spark, sf_dir))


def stored_and_new(spark, sf_dir):
    """Air temperatures end on 15 Jan in the store, the rest on 20 Jan."""
    obs = obs_hourly(spark, sf_dir)
    ends = F.when(F.col("variable") == "Air Temperature", ntz("2024-01-15")).otherwise(
        ntz("2024-01-20")
    )
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    stored = obs.where(F.col("ts") < ends).withColumn("ts", hour)
    new = obs.where(F.col("ts") >= ntz("2024-01-12")).withColumn("ts", hour)
    return stored, new


STORED_NEW = f"""WITH {OBS_HOURLY},
stored AS (
  SELECT {_K}, date_trunc('hour', ts) AS ts, value, qc FROM obs
  WHERE ts < CASE WHEN variable = 'Air Temperature' THEN TIMESTAMP '2024-01-15'
                  ELSE TIMESTAMP '2024-01-20' END),
fresh AS (
  SELECT {_K}, date_trunc('hour', ts) AS ts, value, qc FROM obs
  WHERE ts >= TIMESTAMP '2024-01-12')"""


@query(
    "append_new",
    f"""{STORED_NEW}
SELECT * FROM stored UNION ALL
SELECT * FROM fresh f WHERE NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.station_id = f.station_id AND s.ts = f.ts)""",
)
def append_new(spark, sf_dir):
    return C.append_new(*stored_and_new(spark, sf_dir), "ts")


@query(
    "append_new_by_variable",
    f"""{STORED_NEW}
SELECT * FROM stored UNION ALL
SELECT * FROM fresh f WHERE NOT EXISTS (
  SELECT 1 FROM stored s
  WHERE s.station_id = f.station_id AND s.variable = f.variable AND s.ts = f.ts)""",
)
def append_new_by_variable(spark, sf_dir):
    return C.append_new(*stored_and_new(spark, sf_dir), "ts,variable")


@query(
    "has_new_data",
    f"""{STORED_NEW}
SELECT station_id, bool_or(NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.station_id = f.station_id AND s.ts = f.ts)) AS has_new
FROM fresh f GROUP BY station_id""",
)
def has_new_data(spark, sf_dir):
    return C.has_new_data(*stored_and_new(spark, sf_dir), "ts")


@query(
    "get_observations",
    f"""WITH {OBS_LONG}
SELECT {_K}, ts, value, qc FROM obs WHERE station_id = 'O' AND variable = 'Water Level'""",
)
def get_observations(spark, sf_dir):
    return C.get_observations(obs_long(spark, sf_dir), "O", WATER_LEVEL)


@query("get_variables", f"WITH {OBS_LONG} SELECT DISTINCT {_K} FROM obs")
def get_variables(spark, sf_dir):
    """Of a stored record, from its manifest."""
    path = fresh_path(spark, "record")
    O.write_observations(obs_long(spark, sf_dir), path)
    return O.stored_variables(spark, path)


@query(
    "last_obs",
    f"""WITH {OBS_HOURLY}
SELECT {_K}, max(ts) AS last_obs FROM obs WHERE flag = '0,0,0' GROUP BY {_K}""",
)
def last_obs(spark, sf_dir):
    rows = obs_hourly(spark, sf_dir, True)
    masked = rows.withColumn("value", F.when(F.col("flag") == "0,0,0", F.col("value")))
    return C.last_obs(masked)


@query(
    "inventory_gate",
    """WITH pairs AS (
  SELECT DISTINCT l_suppkey AS station_id, l_returnflag AS product FROM lineitem),
offered AS (
  SELECT l_suppkey AS station_id, l_returnflag AS product, min(l_shipdate) AS start_date
  FROM lineitem WHERE l_quantity = 50 AND l_linestatus = 'O' GROUP BY 1, 2)
SELECT p.* FROM pairs p
WHERE EXISTS (SELECT 1 FROM offered o WHERE o.station_id = p.station_id AND o.product = p.product)""",
)
def inventory_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pair = [F.col("l_suppkey").alias("station_id"), F.col("l_returnflag").alias("product")]
    offered = (
        li.where((F.col("l_quantity") == 50) & (F.col("l_linestatus") == "O"))
        .groupBy(*pair)
        .agg(F.min("l_shipdate").alias("start_date"))
    )
    return C.inventory_gate(li.select(*pair).distinct(), offered)


@query(
    "fetch_plan",
    f"""WITH {OBS_LONG},
inventory AS (SELECT {_K}, CAST(min(ts) AS DATE) AS start_date FROM obs GROUP BY {_K}),
last AS (
  SELECT {_K}, max(ts) AS last_obs FROM obs
  WHERE ts < TIMESTAMP '2001-01-01' AND variable <> 'Water Temperature' GROUP BY {_K})
SELECT i.station_id, i.variable,
       strftime(coalesce(CAST(l.last_obs AS DATE), i.start_date), '%Y%m%d') AS begin_date,
       strftime(DATE '{LONG_AS_OF}' + 1, '%Y%m%d') AS end_date
FROM inventory i LEFT JOIN last l ON l.station_id = i.station_id AND l.variable = i.variable""",
)
def fetch_plan(spark, sf_dir):
    obs = obs_long(spark, sf_dir)
    inventory = obs.groupBy(*KEYS).agg(F.to_date(F.min("ts")).alias("start_date"))
    stored = obs.where(
        (F.col("ts") < ntz("2001-01-01")) & (F.col("variable") != "Water Temperature")
    )
    return C.fetch_plan(inventory, C.last_obs(stored), F.lit(LONG_AS_OF))


