"""The observation record: tables that change by commits, and wide CSV for exchange."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import month_start
from tidemark.operators.combine import assemble_variables, union_variables
from tidemark.schemas import DAILY, KEYS, OBSERVATIONS, STATION, VARIABLE, WATER_LEVEL
from tidemark.snapshots import Layout, Snapshots

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

OBSERVATION_TABLE = Layout(
    "observations",
    OBSERVATIONS,
    time="ts",
    order=(VARIABLE, "ts"),
    key=(*KEYS, "ts"),
    merged=("value", "qc"),
)
DAILY_TABLE = Layout("daily", DAILY, time="date", order=(VARIABLE, "date"))


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store long observations; `mode` is overwrite (of touched years) or append.

    One commit: a writer that dies leaves the record as it was.
    """
    with Snapshots(df.sparkSession, path).begin("write_observations") as commit:
        commit.put(OBSERVATION_TABLE, df, "append" if mode == "append" else "replace")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Stored long observations of the last version."""
    return Snapshots(spark, path).view().read(OBSERVATION_TABLE)


def stored_variables(spark: SparkSession, path: str) -> DataFrame:
    """Variables of each stored station, from the manifest: no reading is looked at."""
    return Snapshots(spark, path).view().series(OBSERVATION_TABLE).select(*KEYS)


def write_daily(df: DataFrame, path: str) -> None:
    """Store daily summaries; touched station years are replaced in one commit."""
    with Snapshots(df.sparkSession, path).begin("write_daily") as commit:
        commit.put(DAILY_TABLE, df)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Stored daily summaries of the last version."""
    return Snapshots(spark, path).view().read(DAILY_TABLE)


def write_bucketed(obs: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Observations as a table bucketed by series and month, for gates without a shuffle.

    `path` is the folder of its files, `table` its name in the session's catalog.
    The buckets are of series and month, so no station is in one task by itself.
    """
    keys = [*KEYS, "month"]
    rows = obs.select(*OBSERVATIONS.fieldNames()).withColumn("month", month_start(F.to_date("ts")))
    rows = rows.repartition(buckets, *keys)
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys, "ts").option("path", path)
    writer.saveAsTable(table)
    return obs.sparkSession.table(table)


def write_record_csv(
    obs: DataFrame, path: str, variables: list[str], tz: str = "lst"
) -> None:
    """Export the record as wide gzip CSV files, one directory per station."""
    wide = assemble_variables(obs, variables).withColumnRenamed("ts", f"time_{tz}")
    (
        wide.hint("rebalance", F.col(STATION))
        .sortWithinPartitions(STATION, f"time_{tz}")
        .write.partitionBy(STATION)
        .option("header", True)
        .option("compression", "gzip")
        .option("timestampNTZFormat", TIME_FORMAT)
        .csv(path)
    )


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header, as the columns of `schema`, found by their names.

    Columns may stand in any order and others beside them; a missing one is an
    error. So are files whose headers differ from the first one's: they are
    refused when they are read, not mislabelled.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {missing}; its columns: {header}")
    return _read_under_header(spark, path, header, schema)


def _read_under_header(
    spark: SparkSession, path: str | list[str], header: list[str], schema: T.StructType
) -> DataFrame:
    types = {f.name: f.dataType for f in schema.fields}
    found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    rows = (
        spark.read.schema(found)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", TIME_FORMAT)
        .csv(path)
    )
    return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def literal_path(path: str) -> str:
    """A path that Spark takes as it stands, without patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_csv_files(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """CSV files, each with a header of its own, as the columns of `schema`.

    The header of a file is its line that names all columns of `schema`. Files
    of one header are one scan. A file with lines but without a header is an
    error; an empty file has no rows. The driver gets one line for each file.
    """
    lines = spark.read.text([literal_path(p) for p in paths])
    names = F.split(F.regexp_replace("value", '[\ufeff"\r]', ""), ",")
    named = F.when(F.forall(F.array(*[F.lit(f.name) for f in schema.fields]), lambda c: F.array_contains(names, c)), F.col("value"))
    headers = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max(named).alias("header"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, line in headers.collect():
        if line is None:
            raise ValueError(f"{path} has no header with the columns {schema.fieldNames()}")
        header = next(csv.reader([line.strip("\ufeff\r")]))
        groups.setdefault(tuple(header), []).append(literal_path(unquote(path)))
    empty = spark.createDataFrame([], schema)
    scans = [_read_under_header(spark, files, list(header), schema) for header, files in sorted(groups.items())]
    return union_variables(*(scans or [empty]))


def read_record_csv(
    spark: SparkSession,
    path: str,
    variables: list[str],
    tz: str = "lst",
    station_id: str | None = None,
) -> DataFrame:
    """Read wide CSV files (plain or gzip) as long observations.

    Columns are found by name and their types declared, never inferred. A
    record of one station without a station column needs `station_id`. Cells
    with neither value nor QC mark are not observations and are left out.
    """
    time = f"time_{tz}"
    qc = f"{WATER_LEVEL} QC"
    fields = [T.StructField(time, T.TimestampNTZType())]
    fields += [T.StructField(v, T.DoubleType()) for v in variables]
    if WATER_LEVEL in variables:
        fields.append(T.StructField(qc, T.StringType()))
    if station_id is None:
        fields.append(T.StructField(STATION, T.StringType()))
    wide = read_csv_by_name(spark, path, T.StructType(fields))
    if station_id is not None:
        wide = wide.withColumn(STATION, F.lit(station_id))
    cells = F.array(
        *[
            F.struct(
                F.lit(v).alias(VARIABLE),
                F.nullif(F.col(v), F.lit(float("nan"))).alias("value"),
                (F.col(qc) if v == WATER_LEVEL else F.lit(None).cast("string")).alias("qc"),
            )
            for v in variables
        ]
    )
    long = wide.select(STATION, F.col(time).alias("ts"), F.inline(cells))
    known = F.col("value").isNotNull() | F.col("qc").isNotNull()
    return long.where(known).select(*KEYS, "ts", "value", "qc")
