"""Tables of one deployment, read and changed as one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.published import drop_empty_stats
from tidemark.schemas import (
    KEYS,
    MONTHS,
    PENDING,
    RANGES,
    RECORD_LOG,
    STATION,
    TRENDS,
    VARIABLE,
    axis_column,
    label_column,
)
from tidemark.snapshots import Commit, Layout, Snapshots, View
from tidemark.sources.metadata import METADATA_TABLE
from tidemark.sources.observations import DAILY_TABLE, OBSERVATION_TABLE
from tidemark.sources.statistics import stats_table

MONTH_TABLE = Layout("months", MONTHS, order=(VARIABLE, "month_start"))
PENDING_TABLE = Layout("pending", PENDING, by_station=False, order=(*KEYS, "date"))
RANGE_TABLE = Layout("ranges", RANGES, order=(VARIABLE, "kind"))
TREND_TABLE = Layout("trends", TRENDS, order=(VARIABLE,))
RECORD_TABLE = Layout("record_log", RECORD_LOG, by_station=False, order=("kind", *KEYS))


class Tables:
    """Reading access to the tables of a view."""

    view: View

    def observations(self, touched: DataFrame | None = None) -> DataFrame:
        """Stored observations, or those of the listed stations (and years)."""
        return self.view.read(OBSERVATION_TABLE, touched)

    def daily(self, touched: DataFrame | None = None, year: int | None = None) -> DataFrame:
        """Daily summaries, or those of the listed stations (and years), or of one year."""
        return self.view.read(DAILY_TABLE, touched, year)

    def stats(self, kind: str, stations: DataFrame | None = None) -> DataFrame:
        """The daily or monthly statistics."""
        return self.view.read(stats_table(kind), stations)

    def filled_stats(self, kind: str) -> DataFrame:
        """The statistics without the columns that hold no value at all.

        The manifest has counted them: a row for each column reaches the driver,
        and no statistic is read before the result is asked for.
        """
        layout = stats_table(kind)
        filled = {r["column"]: r["n_values"] for r in self.view.filled(layout).collect()}
        keep = [*KEYS, axis_column(layout.columns), label_column(layout.columns)]
        return drop_empty_stats(self.view.read(layout), filled, keep)

    def metadata(self) -> DataFrame:
        return self.view.read(METADATA_TABLE)

    def months(self, stations: DataFrame | None = None) -> DataFrame:
        """Months of each series, good and bad."""
        return self.view.read(MONTH_TABLE, stations)

    def pending(self) -> DataFrame:
        """Days that changed since the statistics were made."""
        return self.view.read(PENDING_TABLE)

    def ranges(self, stations: DataFrame | None = None) -> DataFrame:
        """First and last valid date and unit of each variable, by kind of statistics."""
        return self.view.read(RANGE_TABLE, stations)

    def trends(self, stations: DataFrame | None = None) -> DataFrame:
        """Water level trend of each station."""
        return self.view.read(TREND_TABLE, stations)

    def record_log(self, versions: DataFrame | None = None) -> DataFrame:
        """All new records that were ever reported, with the version that did."""
        return self.view.read(RECORD_TABLE, versions=versions)

    def variables(self) -> DataFrame:
        """(station_id, variable) of the record, from the manifest alone."""
        return self.view.series(OBSERVATION_TABLE).select(*KEYS)


class StoreCommit(Tables, Commit):
    """A commit over the tables of a store; it reads what it has written."""


@dataclass(frozen=True)
class Store(Tables):
    """Observations, daily summaries, statistics and metadata below one root.

    Observations and daily summaries are laid out by station and year, so that
    a refresh reads and writes only the years its data falls in. All tables
    change together, by commits; `at` gives an earlier version for as long as
    `vacuum` has kept it.
    """

    spark: SparkSession
    root: str
    version: int | None = None

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.root)

    @property
    def view(self) -> View:
        return self.snapshots.view(self.version)

    def at(self, version: int) -> Store:
        """The store as a version has it."""
        return Store(self.spark, self.root, version)

    def begin(self, job: str, source: str | None = None, batch: int | None = None) -> StoreCommit:
        """A commit on the last version; see `Commit`."""
        return StoreCommit(self.snapshots, job, source, batch)

    def exists(self, table: str) -> bool:
        """Does the table hold any row?"""
        return bool(self.view.folders.get(table))

    def ledger(self) -> DataFrame:
        """One row per commit: job, batch of a source, folders it added."""
        return self.snapshots.commits()

    def vacuum(self, keep: int = 1) -> None:
        """Remove files that the last `keep` versions don't need; see `Snapshots.vacuum`."""
        self.snapshots.vacuum(keep)


def station_years(df: DataFrame, time: str | Column = "ts") -> DataFrame:
    """The (station_id, year) pairs a frame falls in."""
    return df.select(STATION, F.year(time).alias("year")).distinct()
