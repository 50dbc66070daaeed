"""The jobs: first load, refresh, statistics, reprocessing, compaction.

Each job covers all stations of its input at once and is one commit: it reads
one version of the tables and makes the next, with everything it writes, or
makes none. A job that dies can be run again; a batch that is noted in the
ledger isn't worked on twice.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import validate_config
from tidemark.operators.combine import (
    changed_cells,
    last_obs_of_days,
    one_per_time,
    preliminary_days,
    splice_hourly,
    union_variables,
    unseen_rows,
    verified_rows,
)
from tidemark.operators.daily import average_column
from tidemark.operators.published import new_records, stats_changed, yesterday_summary
from tidemark.operators.quality import daily_summary, good_day
from tidemark.operators.restate import (
    restate_daily,
    restate_monthly,
    restate_months,
    restate_ranges,
)
from tidemark.operators.trend import trend_of_months, trend_rates, trend_title
from tidemark.plans.store import (
    MONTH_TABLE,
    PENDING_TABLE,
    RANGE_TABLE,
    RECORD_TABLE,
    TREND_TABLE,
    Store,
    StoreCommit,
    station_years,
)
from tidemark.schemas import (
    DAILY,
    DAY_THRESHOLD,
    HR_THRESHOLD,
    KEYS,
    OBSERVATIONS,
    PENDING,
    RECORD_LOG,
    STATION,
    TRENDS,
    VARIABLE,
    WATER_LEVEL,
    label_column,
)
from tidemark.shared import Workspace, side_by_side
from tidemark.sources.metadata import METADATA_TABLE, build_metadata
from tidemark.sources.observations import DAILY_TABLE, OBSERVATION_TABLE
from tidemark.sources.products import discard_flagged
from tidemark.sources.statistics import stats_table

_KINDS = ("daily", "monthly")


def combine_products(products: dict[str, DataFrame]) -> DataFrame:
    """One observation record from long product rows.

    Flagged readings go, hourly heights are spliced in front of water levels,
    and the rest is put below each other.
    """
    clean = {name: discard_flagged(rows, name) for name, rows in products.items()}
    hourly = clean.pop("hourly_height", None)
    if hourly is not None:
        if "water_level" not in clean:
            raise ValueError("hourly heights need the water levels they lead up to")
        clean["water_level"] = splice_hourly(hourly, clean["water_level"])
    return union_variables(*clean.values()).select(*OBSERVATIONS.fieldNames())


def _metadata_rows(
    commit: StoreCommit, config: DataFrame, last: DataFrame, as_of: date
) -> DataFrame:
    """New metadata of the configured stations.

    `config` has their settings: names and units, both thresholds, average.
    """
    yesterday = as_of - timedelta(days=1)
    settings = config.select(STATION, "hr_threshold", F.col("average").alias("method"))
    recent = commit.daily(year=yesterday.year).join(settings, STATION)
    gated = good_day(recent, F.col("hr_threshold"))
    return build_metadata(
        config,
        last,
        yesterday_summary(gated, F.lit(as_of).cast("date"), F.col("method")),
        F.col("hr_threshold"),
        F.col("day_threshold"),
        F.col("average"),
    )


def initial_load(
    store: Store,
    record: DataFrame,
    config: DataFrame,
    as_of: date,
    hr_threshold: int = HR_THRESHOLD,
    day_threshold: int = DAY_THRESHOLD,
    redownload: bool = False,
    average: str = "midrange",
) -> None:
    """First load of the stations in `config`: record, daily table, statistics.

    `record` is the output of `combine_products`; `config` has stationname,
    station_id, unit_system, tz and datum and is checked before any write. A
    station that is loaded already is only replaced with `redownload`. The
    averaging method is kept as a setting of the stations.
    """
    average_column(average)  # An unknown method is an error before any write.
    checked = validate_config(config, fail=True).withColumns(
        {
            "hr_threshold": F.lit(hr_threshold),
            "day_threshold": F.lit(day_threshold),
            "average": F.lit(average),
        }
    )
    with Workspace(store.spark) as work, store.begin("initial_load") as commit:
        checked = work.stage(checked, "config")
        stations = checked.select(STATION)
        loaded = commit.metadata().join(stations, STATION, "left_semi")
        if not redownload and not loaded.isEmpty():
            raise ValueError("a station is loaded already; pass redownload=True to replace it")
        record = one_per_time(record.select(*OBSERVATIONS.fieldNames()))
        record = record.join(stations, STATION, "left_semi")
        commit.put(OBSERVATION_TABLE, record, stations=stations)
        commit.put(DAILY_TABLE, daily_summary(commit.observations(stations)), stations=stations)
        last = last_obs_of_days(commit.daily(stations))
        commit.put(METADATA_TABLE, _metadata_rows(commit, checked, last, as_of))
        metadata = commit.metadata().join(stations, STATION, "left_semi")
        _restate(commit, work, metadata, None, report=False)
        _settle(commit, work, stations)


def update_data(
    store: Store,
    batch: DataFrame,
    as_of: date,
    append_key: str = "ts,variable",
    source: str | None = None,
    batch_id: int | None = None,
) -> bool:
    """Refresh the record with newly landed observations, as one commit.

    Only stations with metadata take part. Verified water levels lie as deltas
    over preliminary ones, rows at unseen times are appended, and the daily
    summaries of the station years that really changed follow, with a note of
    the days that did. A batch of a `source` that the ledger knows by its
    `batch_id` changes nothing. Returns whether the batch brought any new time.
    """
    with Workspace(store.spark) as work, store.begin("update_data", source, batch_id) as commit:
        return not commit.seen and refresh_data(commit, work, batch, as_of, append_key)


def refresh_data(
    commit: StoreCommit,
    work: Workspace,
    batch: DataFrame,
    as_of: date,
    append_key: str = "ts,variable",
) -> bool:
    """`update_data` as a step of a commit."""
    config = commit.metadata()
    ours = batch.select(*OBSERVATIONS.fieldNames()).join(
        config.select(STATION), STATION, "left_semi"
    )
    batch = work.stage(one_per_time(ours), "batch")
    held = commit.observations(work.stage(station_years(batch), "touched-years"))
    added = work.stage(unseen_rows(held, batch, append_key), "new-rows")

    # The preliminary range of the whole record comes from the daily summaries.
    levels = batch.where(F.col(VARIABLE) == WATER_LEVEL)
    days = commit.daily(work.stage(levels.select(STATION).distinct(), "with-levels"))
    ranges = preliminary_days(days.where(F.col(VARIABLE) == WATER_LEVEL))
    fresh = work.stage(verified_rows(levels, work.stage(ranges, "ranges")), "verified")
    cells = commit.observations(work.stage(station_years(fresh), "verified-years"))
    cells = work.stage(changed_cells(cells, fresh), "changed-cells")

    years = work.stage(station_years(added.unionByName(cells)), "changed-years")
    before = commit.daily(years)
    has_new, has_cells = not added.isEmpty(), not cells.isEmpty()
    if has_cells:
        commit.put(OBSERVATION_TABLE, cells, "delta")
    if has_new:
        commit.put(OBSERVATION_TABLE, added, "append")
    writes = []
    if has_new or has_cells:
        commit.put(DAILY_TABLE, daily_summary(commit.observations(years)))
        writes.append((PENDING_TABLE, changed_days(before, commit.daily(years)), "append"))

    known = config.select(STATION, F.explode("last_obs").alias(VARIABLE, "last_obs"))
    last = (
        known.unionByName(last_obs_of_days(commit.daily(years)))
        .groupBy(*KEYS)
        .agg(F.max("last_obs").alias("last_obs"))
    )
    settings = config.drop("variables", "units", "last_obs", "yesterday", "dirname")
    commit.put_all((METADATA_TABLE, _metadata_rows(commit, settings, last, as_of)), *writes)
    return has_new


def changed_days(before: DataFrame, after: DataFrame) -> DataFrame:
    """(station_id, variable, date) of the daily summaries that aren't the same."""
    on = [*KEYS, "date"]
    values = [c for c in DAILY.fieldNames() if c not in on]
    old = before.select(*on, F.struct(*values).alias("old"))
    pairs = old.join(after.select(*on, F.struct(*values).alias("new")), on, "full")
    return pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select(*on)


def _restate(
    commit: StoreCommit,
    work: Workspace,
    metadata: DataFrame,
    changed: DataFrame | None,
    report: bool = True,
) -> None:
    """Statistics, months, data ranges, trends and new records of some stations.

    `metadata` are the rows of these stations; `changed` are the days to go by,
    or None to make everything anew. A first load reports nothing. Reads the daily summaries, months and
    statistics of these stations and nothing else.
    """
    settings = work.stage(
        metadata.select(
            STATION, "hr_threshold", "day_threshold", F.col("average").alias("method"), "units"
        ),
        "settings",
    )
    stations = settings.select(STATION)
    gated = good_day(
        commit.daily(stations).join(settings.drop("units"), STATION), F.col("hr_threshold")
    )
    if changed is not None:
        series = changed.select(*KEYS).distinct()
        gated = gated.join(series, KEYS, "left_semi")
    units = settings.select(STATION, F.explode("units").alias(VARIABLE, "unit"))
    average, threshold = F.col("method"), F.col("day_threshold")

    def others(table: DataFrame) -> DataFrame:
        """Rows of series that didn't change; none if everything is made anew."""
        return table.limit(0) if changed is None else table.join(series, KEYS, "left_anti")

    def ours(table: DataFrame) -> DataFrame:
        return table if changed is None else table.join(series, KEYS, "left_semi")

    held = commit.months(stations)
    months = work.stage(restate_months(ours(held), gated, changed, average, threshold), "months")
    writes = [(MONTH_TABLE, others(held).unionByName(months), "replace", stations)]

    def statistics(kind: str) -> tuple[DataFrame, DataFrame]:
        """New records, and the whole statistics of the stations where some changed."""
        held = commit.stats(kind, stations)
        old = ours(held)
        if kind == "daily":
            new = restate_daily(old, gated, changed, average)
        else:
            new = restate_monthly(old, months, changed)
        new = work.stage(new, f"{kind}-stats")
        rows = new_records(old, new, units).withColumnRenamed(label_column(new.columns), "label")
        rows = rows.withColumns({"version": F.lit(commit.version), "kind": F.lit(kind)})
        moved = stats_changed(old, new).where("changed").select(STATION)
        moved = work.stage(moved, f"{kind}-changed")
        whole = new.unionByName(others(held)).join(moved, STATION, "left_semi")
        return rows.select(*RECORD_LOG.fieldNames()), whole

    found = side_by_side(*[partial(statistics, kind) for kind in _KINDS])
    writes += [(stats_table(kind), whole) for kind, (_, whole) in zip(_KINDS, found, strict=True)]
    if report:
        writes.append((RECORD_TABLE, found[0][0].unionByName(found[1][0]), "append"))

    ranges = others(commit.ranges(stations)).unionByName(restate_ranges(gated, months, units))
    rates = trend_rates(trend_of_months(months.where("enough")))
    headings = trend_title(rates, units)
    rates = rates.join(headings, KEYS, "left").select(*TRENDS.fieldNames())
    trends = others(commit.trends(stations)).unionByName(rates)
    writes += [(RANGE_TABLE, ranges, "replace", stations), (TREND_TABLE, trends, "replace", stations)]
    commit.put_all(*writes)


def update_stats(
    store: Store, average: str | None = None, stations: list[str] | None = None
) -> dict[str, DataFrame]:
    """Bring the statistics up to date, report new records, replace what changed.

    Only labels of days that changed since the last time are aggregated again,
    of all or of the named stations. Another `average` than the stored one
    becomes the setting of these stations and makes their statistics anew.
    Returns the new records of the daily and of the monthly table; they are in
    the record log as well, by the same commit.
    """
    with Workspace(store.spark) as work, store.begin("update_stats") as commit:
        refresh_stats(commit, work, average, stations)
        return _report(commit)


def _report(commit: StoreCommit) -> dict[str, DataFrame]:
    """What a commit has added to the record log, by kind."""
    version = commit.spark.range(commit.version, commit.version + 1).select(
        F.col("id").cast("int").alias("version")
    )
    rows = commit.record_log(version)
    labels = {"daily": "date_label", "monthly": "month_label"}
    return {
        kind: rows.where(F.col("kind") == kind)
        .drop("version", "kind")
        .withColumnRenamed("label", labels[kind])
        for kind in _KINDS
    }


def refresh_stats(
    commit: StoreCommit,
    work: Workspace,
    average: str | None = None,
    stations: list[str] | None = None,
) -> None:
    """`update_stats` as a step of a commit."""

    def named(df: DataFrame) -> Column:
        return F.lit(True) if stations is None else F.col(STATION).isin(stations)

    if average is not None:
        average_column(average)
        moved = commit.metadata().where(named(commit.metadata()) & ~F.col("average").eqNullSafe(F.lit(average)))
        moved = work.stage(moved.withColumn("average", F.lit(average)), "other-average")
        if not moved.isEmpty():
            commit.put(METADATA_TABLE, moved)
            _restate(commit, work, moved, None)
            _settle(commit, work, moved.select(STATION))
    changed = commit.pending().where(named(commit.pending())).distinct()
    changed = work.stage(changed, "changed-days")
    if changed.isEmpty():
        return
    touched = changed.select(STATION).distinct()
    _restate(commit, work, commit.metadata().join(touched, STATION, "left_semi"), changed)
    _settle(commit, work, touched)


def _settle(commit: StoreCommit, work: Workspace, stations: DataFrame) -> None:
    """Nothing is pending for these stations any more."""
    if not commit.view.exists(PENDING_TABLE):
        return
    left = commit.pending().join(stations, STATION, "left_anti").select(*PENDING.fieldNames())
    left = work.stage(left, "still-pending")
    commit.clear(PENDING_TABLE)
    if not left.isEmpty():
        commit.put(PENDING_TABLE, left, "append")


def reprocess(
    store: Store,
    hr_threshold: int,
    day_threshold: int,
    stations: list[str] | None = None,
    average: str | None = None,
) -> dict[str, DataFrame]:
    """New thresholds (and average) for some or all stations; observations are not read.

    The daily table keeps the hours of every day, so the gates are simply
    applied again.
    """
    settings = {"hr_threshold": F.lit(hr_threshold), "day_threshold": F.lit(day_threshold)}
    if average is not None:
        average_column(average)
        settings["average"] = F.lit(average)
    with Workspace(store.spark) as work, store.begin("reprocess") as commit:
        metadata = commit.metadata()
        if stations is not None:
            metadata = metadata.where(F.col(STATION).isin(stations))
        metadata = work.stage(metadata.withColumns(settings), "metadata")
        commit.put(METADATA_TABLE, metadata)
        _restate(commit, work, metadata, None)
        _settle(commit, work, metadata.select(STATION))
        return _report(commit)


def compact(store: Store, min_parts: int = 2) -> None:
    """Rewrite station years of the record that lie in several parts as one.

    Deltas go into the readings they replace, appended files into one. Readers
    see the same rows before and after.
    """
    with Workspace(store.spark) as work, store.begin("compact") as commit:
        parts = commit.view.parts(OBSERVATION_TABLE).groupBy(STATION, "year")
        many = parts.agg(F.count("*").alias("n")).where(F.col("n") >= min_parts)
        many = work.stage(many.select(STATION, "year"), "many-parts")
        if not many.isEmpty():
            commit.put(OBSERVATION_TABLE, commit.observations(many))
