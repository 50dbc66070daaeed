"""Station metadata: one row per station with its settings and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import station_dirname, unit_for
from tidemark.schemas import DAY_THRESHOLD, HR_THRESHOLD, METADATA, STATION, VARIABLE
from tidemark.snapshots import Layout, Snapshots


def _map_of(value: Column | str) -> Column:
    """Map of variable to value; one entry per variable of a station.

    Sorted, so that the same content always makes the same map.
    """
    v = F.col(value) if isinstance(value, str) else value
    entry = F.when(v.isNotNull(), F.struct(F.col(VARIABLE).alias("k"), v.alias("v")))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def build_metadata(
    config: DataFrame,
    last: DataFrame,
    yesterday: DataFrame,
    hr_threshold: int | Column = HR_THRESHOLD,
    day_threshold: int | Column = DAY_THRESHOLD,
    average: str | Column = "midrange",
) -> DataFrame:
    """Metadata rows from station settings, last observations and yesterday.

    `config` has stationname, station_id, unit_system, tz and datum; `last` the
    output of `last_obs`; `yesterday` that of `yesterday_summary`. Both have
    one row per station and variable.
    """

    def column(t: int | Column) -> Column:
        return (F.lit(t) if isinstance(t, int) else t).cast("int")

    observed = (
        last.join(config.select(STATION, "unit_system"), STATION)
        .groupBy(STATION)
        .agg(
            F.array_sort(F.collect_list(VARIABLE)).alias("variables"),
            _map_of(unit_for(VARIABLE, "unit_system")).alias("units"),
            _map_of("last_obs").alias("last_obs"),
        )
    )
    recent = yesterday.groupBy(STATION).agg(
        F.struct(
            _map_of("average").alias("average"),
            _map_of("high").alias("high"),
            _map_of("low").alias("low"),
        ).alias("yesterday")
    )
    return (
        config.join(observed, STATION, "left")
        .join(recent, STATION, "left")
        .withColumns(
            {
                "dirname": station_dirname("stationname"),
                "hr_threshold": column(hr_threshold),
                "day_threshold": column(day_threshold),
                "average": F.lit(average) if isinstance(average, str) else average,
            }
        )
        .select(*METADATA.fieldNames())
    )


METADATA_TABLE = Layout("metadata", METADATA)


def write_metadata(df: DataFrame, path: str) -> None:
    """Store metadata rows; stations in the data are replaced, others stay.

    One commit: a writer that dies leaves the metadata as they were.
    """
    with Snapshots(df.sparkSession, path).begin("write_metadata") as commit:
        commit.put(METADATA_TABLE, df)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stored metadata rows of the last version."""
    return Snapshots(spark, path).view().read(METADATA_TABLE)


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """Metadata as one row per station and variable."""
    day = "yesterday"
    rows = metadata.select("*", F.explode("variables").alias(VARIABLE))

    def of(c: str) -> Column:
        return F.try_element_at(F.col(c), F.col(VARIABLE))

    return rows.select(
        STATION,
        VARIABLE,
        "stationname",
        "dirname",
        "unit_system",
        "tz",
        "datum",
        "hr_threshold",
        "day_threshold",
        of("units").alias("unit"),
        of("last_obs").alias("last_obs"),
        of(f"{day}.average").alias("yesterday_average"),
        of(f"{day}.high").alias("yesterday_high"),
        of(f"{day}.low").alias("yesterday_low"),
    )
