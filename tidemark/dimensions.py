"""Small lookup tables that come with the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import unit_for
from tidemark.schemas import KEYS

# Station names and ids.
STATIONS = {
    "Beaufort, NC": "8656483",
    "Virginia Key, FL": "8723214",
    "Woods Hole, MA": "8447930",
    "Naples, FL": "8725114",
    "Lewes, DE": "8557380",
    "Bay St. Louis, MS": "8747437",
    "Newport, RI": "8452660",
}

# Flood levels in feet.
FLOOD_LEVELS = {
    "Virginia Key, FL": {"major": 2.5, "moderate": 1.7, "minor": 1.3},
    "Lewes, DE": {"major": 8.0, "moderate": 7.0, "minor": 6.0},
    "Beaufort, NC": {"major": 6.5, "moderate": 5.5, "minor": 5.0},
    "Newport, RI": {"major": 9.0, "moderate": 7.5, "minor": 6.0},
    "Woods Hole, MA": {"major": 8.5, "moderate": 7.0, "minor": 5.5},
    "Naples, FL": {"major": 3.5, "moderate": 2.5, "minor": 1.5},
    "Bay St. Louis, MS": {"major": 0.0, "moderate": 0.0, "minor": 0.0},
}


def flood_thresholds(spark: SparkSession) -> DataFrame:
    """Flood levels of the known stations: (station_id, level, value)."""
    rows = [
        (STATIONS[name], level, value)
        for name, levels in FLOOD_LEVELS.items()
        for level, value in levels.items()
    ]
    return spark.createDataFrame(rows, "station_id string, level string, value double")


def station_units(series: DataFrame, unit_system: str = "english") -> DataFrame:
    """Unit of each (station, variable) that occurs in a frame."""
    return series.select(*KEYS).distinct().withColumn(
        "unit", unit_for("variable", F.lit(unit_system))
    )
