"""Published statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schemas import DAILY_STATS, MONTHLY_STATS, STATION, VARIABLE
from tidemark.snapshots import Layout, Snapshots


def stats_schema(kind: str) -> T.StructType:
    """Layout of the daily or monthly statistics table."""
    if kind not in ("daily", "monthly"):
        raise ValueError(f"kind must be 'daily' or 'monthly', not {kind!r}")
    axis, label = ("yearday", "date_label") if kind == "daily" else ("month", "month_label")
    columns = DAILY_STATS if kind == "daily" else MONTHLY_STATS
    fields = [
        T.StructField(STATION, T.StringType()),
        T.StructField(VARIABLE, T.StringType()),
        T.StructField(axis, T.IntegerType()),
        T.StructField(label, T.StringType()),
    ]
    for c in columns:
        whole = c == "years" or c.endswith("_year")
        fields.append(T.StructField(c, T.IntegerType() if whole else T.DoubleType()))
    return T.StructType(fields)


def stats_table(kind: str) -> Layout:
    """How the daily or monthly statistics table is stored."""
    schema = stats_schema(kind)
    statistics = DAILY_STATS if kind == "daily" else MONTHLY_STATS
    return Layout(f"{kind}_stats", schema, order=(VARIABLE, schema.fieldNames()[2]), counted=tuple(statistics))


def write_stats(df: DataFrame, path: str, kind: str) -> None:
    """Store a statistics table; stations in the data are replaced, others stay.

    One commit: a writer that dies leaves the table as it was.
    """
    with Snapshots(df.sparkSession, path).begin("write_stats") as commit:
        commit.put(stats_table(kind), df)


def read_stats(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A stored statistics table, as the last version has it."""
    return Snapshots(spark, path).view().read(stats_table(kind))


def filled_columns(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(column, n_values) of a stored statistics table, from the manifest alone."""
    return Snapshots(spark, path).view().filled(stats_table(kind))
