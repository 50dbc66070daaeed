"""Column layouts shared by every module.

The engine keeps one long observation layout for all stations and variables.
A new variable is new rows, never a new column.
"""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "station_id"
VARIABLE = "variable"
KEYS = [STATION, VARIABLE]

WATER_LEVEL = "Water Level"

OBSERVATIONS = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("qc", T.StringType()),
    ]
)

DAILY = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("mid", T.DoubleType()),
        T.StructField("n_hours", T.IntegerType()),
        T.StructField("preliminary", T.BooleanType()),
        T.StructField("last_obs", T.TimestampNTZType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("stationname", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("dirname", T.StringType()),
        T.StructField("unit_system", T.StringType()),
        T.StructField("tz", T.StringType()),
        T.StructField("datum", T.StringType()),
        T.StructField("hr_threshold", T.IntegerType()),
        T.StructField("day_threshold", T.IntegerType()),
        T.StructField("average", T.StringType()),
        T.StructField("variables", T.ArrayType(T.StringType())),
        T.StructField("units", T.MapType(T.StringType(), T.StringType())),
        T.StructField("last_obs", T.MapType(T.StringType(), T.TimestampNTZType())),
        T.StructField(
            "yesterday",
            T.StructType(
                [
                    T.StructField("average", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("high", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("low", T.MapType(T.StringType(), T.DoubleType())),
                ]
            ),
        ),
    ]
)


#: Months of each series: what the monthly statistics are made of.
MONTHS = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("month_start", T.DateType()),
        T.StructField("n_days", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("first_date", T.DateType()),
        T.StructField("last_date", T.DateType()),
        T.StructField("enough", T.BooleanType()),
    ]
)

#: Days whose summary changed since the statistics were made.
PENDING = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("date", T.DateType()),
    ]
)

#: First and last valid date of each variable, and its unit.
RANGES = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("unit", T.StringType()),
    ]
)

TRENDS = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("start_month", T.DateType()),
        T.StructField("end_month", T.DateType()),
        T.StructField("per_year", T.DoubleType()),
        T.StructField("per_century", T.DoubleType()),
        T.StructField("heading", T.StringType()),
    ]
)

#: New records as each refresh found them.
RECORD_LOG = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("record", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("old_value", T.DoubleType()),
        T.StructField("old_year", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)


def _product(*columns: tuple[str, T.DataType]) -> T.StructType:
    base = [
        T.StructField("station_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
    return T.StructType(base + [T.StructField(n, t) for n, t in columns])


_D, _S = T.DoubleType(), T.StringType()

# Column layouts of the landed files, one per product.
PRODUCTS: dict[str, T.StructType] = {
    "air_temperature": _product(("atemp", _D), ("atemp_flag", _S)),
    "water_temperature": _product(("wtemp", _D), ("wtemp_flag", _S)),
    "air_pressure": _product(("apres", _D), ("apres_flag", _S)),
    "wind": _product(
        ("windspeed", _D),
        ("winddir_deg", _D),
        ("winddir", _S),
        ("windgust", _D),
        ("wind_flag", _S),
    ),
    "water_level": _product(
        ("wlevel", _D), ("s", _D), ("wlevel_flag", _S), ("wlevel_qc", _S)
    ),
    "hourly_height": _product(("wlevel", _D), ("s", _D), ("wlevel_flag", _S)),
}

# Fixed values. For each product: value column -> variable name, the flag column, the qc column.
PRODUCT_VARIABLES: dict[str, dict] = {
    "air_temperature": {"values": {"atemp": "Air Temperature"}, "flag": "atemp_flag"},
    "water_temperature": {"values": {"wtemp": "Water Temperature"}, "flag": "wtemp_flag"},
    "air_pressure": {"values": {"apres": "Barometric Pressure"}, "flag": "apres_flag"},
    "wind": {
        "values": {"windspeed": "Wind Speed", "windgust": "Wind Gust"},
        "flag": "wind_flag",
    },
    "water_level": {
        "values": {"wlevel": WATER_LEVEL},
        "flag": "wlevel_flag",
        "qc": "wlevel_qc",
    },
    "hourly_height": {"values": {"wlevel": WATER_LEVEL}, "flag": "wlevel_flag"},
}

# Unit of every variable in each unit system.
UNITS: dict[str, dict[str, str]] = {
    "Air Temperature": {"metric": "°C", "english": "°F"},
    "Barometric Pressure": {"metric": "mb", "english": "mb"},
    "Wind Speed": {"metric": "m/s", "english": "kn"},
    "Wind Gust": {"metric": "m/s", "english": "kn"},
    "Wind Direction": {"metric": "deg", "english": "deg"},
    "Water Temperature": {"metric": "°C", "english": "°F"},
    "Water Level": {"metric": "m", "english": "ft"},
}

# What a station configuration may say.
UNIT_SYSTEMS = ["metric", "english"]
TIME_ZONES = ["gmt", "lst", "lst_ldt"]
DATUMS = ["STND", "MHHW", "MHW", "MTL", "MSL", "MLW", "MLLW", "NAVD"]

# A reading that stands for bad data, and the default gates.
FILL_VALUE = 31.8
HR_THRESHOLD = 4
DAY_THRESHOLD = 2

# Statistic columns of the published tables, in their order. Columns that end
# in "_year" hold the year of the statistic before them.
DAILY_STATS = [
    "daily_average",
    "record_high_daily_average",
    "record_high_daily_average_year",
    "record_low_daily_average",
    "record_low_daily_average_year",
    "average_high",
    "lowest_high",
    "lowest_high_year",
    "record_high",
    "record_high_year",
    "average_low",
    "highest_low",
    "highest_low_year",
    "record_low",
    "record_low_year",
    "years",
]
MONTHLY_STATS = [c.replace("daily_average", "monthly_average") for c in DAILY_STATS]


def record_names(columns: list[str]) -> list[str]:
    """Statistics that carry a year, in column order."""
    return [c.removesuffix("_year") for c in columns if c.endswith("_year")]


def label_column(columns: list[str]) -> str:
    """Name of the label column of a published table."""
    return "date_label" if "date_label" in columns else "month_label"


def axis_column(columns: list[str]) -> str:
    """Name of the integer axis of a published table."""
    return "yearday" if "yearday" in columns else "month"
