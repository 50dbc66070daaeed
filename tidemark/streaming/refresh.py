"""Refresh driven by landing files.

A file stream per product picks up what has landed since the last run and
hands it to the refresh job. The job gives the same result when a batch is
replayed, so a restart from the checkpoint is safe.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.combine import union_variables
from tidemark.plans.jobs import refresh_data, refresh_stats
from tidemark.plans.store import Store
from tidemark.shared import Workspace
from tidemark.snapshots import COMMIT
from tidemark.sources.products import discard_flagged, normalise_product, read_landed_files


LANDED = "path string, modificationTime timestamp, length long, content binary"


def landed_stream(store: Store, path: str, product: str) -> DataFrame:
    """(product, path) of each file as it lands; contents aren't read."""
    files = store.spark.readStream.schema(LANDED).format("binaryFile").load(path)
    return files.select(F.lit(product).alias("product"), "path")


def landed_observations(spark: SparkSession, files: DataFrame, fmt: str = "csv") -> DataFrame:
    """Clean observations of the files of a batch.

    CSV columns go by the header of each file, so their order may change from
    file to file. The driver gets the paths, as it has listed them for the stream.
    """
    landed: dict[str, list[str]] = {}
    for r in files.distinct().orderBy("product", "path").collect():
        landed.setdefault(r.product, []).append(r.path)
    rows = (normalise_product(read_landed_files(spark, p, product, fmt), product) for product, p in landed.items())
    return union_variables(*(discard_flagged(r, product) for r, product in zip(rows, landed, strict=True)))


def refresh_on_landing(
    store: Store,
    landing: dict[str, str],
    checkpoint: str,
    as_of: date,
    fmt: str = "csv",
    append_key: str = "ts,variable",
) -> StreamingQuery:
    """Process everything that has landed, then stop.

    `landing` maps products to their folders. Hourly heights belong to the
    first load and are not accepted here. Data, statistics and the report of new
    records of a batch are one commit, noted in the ledger under the checkpoint,
    so a batch that is replayed after a failure counts once. The report is read
    from the store's record log or followed with `follow_records`.
    """
    if "hourly_height" in landing:
        raise ValueError("hourly heights are spliced in by the first load only")
    streams = [landed_stream(store, path, product) for product, path in landing.items()]

    def refresh(batch: DataFrame, number: int) -> None:
        with Workspace(store.spark) as work, store.begin("refresh", checkpoint, number) as commit:
            if not commit.seen and not batch.isEmpty():
                rows = landed_observations(store.spark, batch, fmt)
                refresh_data(commit, work, rows, as_of, append_key)
                refresh_stats(commit, work)

    return (
        union_variables(*streams)
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_records(
    store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand over the new records of every commit since the last time, then stop.

    The stream reads commit files, each of which appears once and whole; the log
    rows of their versions are read by parts, so earlier ones aren't opened. The
    store must have a first version. `handle` gets the rows and the number of
    the stream's batch, under which a replay after a failure gives the same rows.
    """
    commits = store.spark.readStream.schema(COMMIT).json(f"{store.snapshots.root}/_commits/*.json")

    def hand_over(batch: DataFrame, number: int) -> None:
        handle(store.record_log(batch.select("version")), number)

    return (
        commits.select("version")
        .writeStream.foreachBatch(hand_over)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
