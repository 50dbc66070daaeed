"""Landed product files, brought to the long observation layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag_sum, nan_to_null
from tidemark.schemas import KEYS, PRODUCT_VARIABLES, PRODUCTS
from tidemark.sources.observations import literal_path, read_csv_by_name, read_csv_files

# Product rows in the long layout still carry their flags.
PRODUCT_ROWS = [*KEYS, "ts", "value", "qc", "flag"]


def check_product(product: str) -> None:
    if product not in PRODUCTS:
        raise ValueError(f"unknown product {product!r}; known: {sorted(PRODUCTS)}")


def read_landed(spark: SparkSession, path: str, product: str, fmt: str = "csv") -> DataFrame:
    """Landed files of one product, with its declared schema; columns go by name."""
    check_product(product)
    if fmt == "csv":
        return read_csv_by_name(spark, path, PRODUCTS[product])
    return spark.read.schema(PRODUCTS[product]).format(fmt).load(path)


def read_landed_files(spark: SparkSession, paths: list[str], product: str, fmt: str = "csv") -> DataFrame:
    """Given files of one product; the columns of each CSV file go by its own header."""
    check_product(product)
    if fmt == "csv":
        return read_csv_files(spark, paths, PRODUCTS[product])
    return spark.read.schema(PRODUCTS[product]).format(fmt).load([literal_path(p) for p in paths])


def normalise_product(df: DataFrame, product: str) -> DataFrame:
    """Product columns as long rows: one row per value column.

    Hourly heights are verified by definition; products without QC marks have
    none.
    """
    check_product(product)
    spec = PRODUCT_VARIABLES[product]
    if product == "hourly_height":
        qc = F.lit("v")
    elif "qc" in spec:
        qc = F.col(spec["qc"])
    else:
        qc = F.lit(None).cast("string")
    cells = F.array(
        *[
            F.struct(F.lit(variable).alias("variable"), nan_to_null(column).alias("value"))
            for column, variable in spec["values"].items()
        ]
    )
    rows = df.select(
        "station_id", "ts", qc.alias("qc"), F.col(spec["flag"]).alias("flag"), F.inline(cells)
    )
    return rows.select(*PRODUCT_ROWS)


def read_product(spark: SparkSession, path: str, product: str, fmt: str = "csv") -> DataFrame:
    """Landed files of one product as long rows with their flags."""
    return normalise_product(read_landed(spark, path, product, fmt), product)


def discard_flagged(rows: DataFrame, product: str) -> DataFrame:
    """Observations without suspect readings.

    A flagged reading keeps its row with a missing value. A flagged hourly
    height is missing altogether, including its QC mark.
    """
    check_product(product)
    raised = flag_sum("flag") > 0

    def unless(c: str) -> Column:
        return F.when(raised, None).otherwise(F.col(c)).alias(c)

    qc = unless("qc") if product == "hourly_height" else F.col("qc")
    return rows.select(*KEYS, "ts", unless("value"), qc)
