"""The station registry: names and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import station_dirname, station_key


def read_stations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Registry files, each one JSON object of station name to station id.

    With `lines` every line is such an object, so that a large registry is
    read in parallel.
    """
    text = spark.read.text(path, wholetext=not lines)
    registry = F.from_json("value", "map<string,string>")
    return text.select(F.explode(registry).alias("station_name", "station_id"))


def resolve_stations(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested station names with their id and key.

    A name the registry does not hold stays, with a NULL id and `known` false.
    """
    return requested.join(
        registry.select("station_name", "station_id"), "station_name", "left"
    ).withColumns(
        {
            "known": F.col("station_id").isNotNull(),
            "station_key": station_key("station_name"),
            "dirname": station_dirname("station_name"),
        }
    )
