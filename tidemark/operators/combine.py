"""Putting observation series together: assemble, splice, overlay, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import format_date
from tidemark.schemas import KEYS, STATION, VARIABLE, WATER_LEVEL

_AT = [*KEYS, "ts"]
APPEND_KEYS = {"ts": [STATION, "ts"], "ts,variable": _AT}


def union_variables(*frames: DataFrame) -> DataFrame:
    """Long observations of several products as one frame."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def assemble_variables(obs: DataFrame, variables: list[str]) -> DataFrame:
    """Wide record: one row per station and time, one column per variable.

    Times are the union over all variables. `variables` is explicit, so no
    extra job has to look for the column names. Water level brings its QC mark.
    """
    value, mark = _preferences()
    picks = {v: F.min(F.when(F.col(VARIABLE) == v, value))["value"].alias(v) for v in variables}
    if WATER_LEVEL in variables:
        level = F.min(F.when(F.col(VARIABLE) == WATER_LEVEL, mark))["qc"]
        picks[f"{WATER_LEVEL} QC"] = level.alias(f"{WATER_LEVEL} QC")
    wide = obs.where(F.col(VARIABLE).isin(variables)).groupBy(STATION, "ts")
    return wide.agg(*picks.values())


def _preferences(rank: Column | None = None) -> tuple[Column, Column]:
    """Order of preference among the readings of one time, of their values and of their marks.

    The least struct counts. Lowest rank first; of values one that is there,
    then a verified one, then the lowest; of marks the verified one, then any
    other. So a missing verified reading marks the time but never hides a value,
    whether both come in one batch or one after the other.
    """
    first = F.lit(0) if rank is None else rank
    unverified = F.when(F.col("qc") == "v", 0).otherwise(1).alias("unverified")
    value = F.struct(first.alias("rank"), F.col("value").isNull().alias("missing"), unverified, "value")
    mark = F.struct(first.alias("rank"), unverified, F.col("qc").isNull().alias("missing"), "qc")
    return value, mark


def one_per_time(obs: DataFrame, rank: Column | None = None) -> DataFrame:
    """One row per station, variable and time, by rank and `_preferences`."""
    value, mark = _preferences(rank)
    best = obs.groupBy(*_AT).agg(F.min(value).alias("of_value"), F.min(mark).alias("of_mark"))
    return best.select(*_AT, "of_value.value", "of_mark.qc")


def splice_bounds(hourly: DataFrame, levels: DataFrame) -> DataFrame:
    """Where hourly heights end, for each series and year that has some.

    One aggregate over both inputs makes a row per series and day, which is
    already small; the bounds of a series are windows over its days. Rows by
    year let the join with the readings split a hot station.
    """
    both = hourly.select(*KEYS, F.to_date("ts").alias("date"), F.col("ts").alias("height"), F.lit(None).cast("timestamp_ntz").alias("level"))
    both = both.unionByName(
        levels.select(*KEYS, F.to_date("ts").alias("date"), F.lit(None).cast("timestamp_ntz").alias("height"), F.col("ts").alias("level"))
    )
    days = both.groupBy(*KEYS, "date").agg(F.max("height").alias("height"), F.min("level").alias("level"))
    series = Window.partitionBy(*KEYS)
    days = days.withColumn("through", F.date_add(F.to_date(F.min("level").over(series)), 1))
    inside = F.col("through").isNull() | (F.col("date") <= F.col("through"))
    days = days.withColumn("last_hourly", F.max(F.when(inside, F.col("height"))).over(series))
    years = days.where(F.col("height").isNotNull()).groupBy(*KEYS, F.year("date").alias("year"))
    return years.agg(F.min("through").alias("through"), F.min("last_hourly").alias("last_hourly"))


def splice_hourly(hourly: DataFrame, levels: DataFrame) -> DataFrame:
    """Hourly heights in front of six-minute levels of the same series.

    Hourly rows run through the day after the first level and lose their last
    row; at equal times the hourly row stays, even if its value is missing.
    Each input is read twice, once for the bounds; nothing runs before the
    result is asked for.
    """
    on = [*KEYS, "year"]
    dated = hourly.select(*_AT, "value", "qc", F.year("ts").alias("year"))
    older = dated.join(splice_bounds(hourly, levels), on).where(
        (F.col("through").isNull() | (F.to_date("ts") <= F.col("through")))
        & (F.col("ts") < F.col("last_hourly"))
    )
    both = older.select(*_AT, "value", "qc", F.lit(0).alias("rank")).unionByName(
        levels.select(*_AT, "value", "qc", F.lit(1).alias("rank"))
    )
    return one_per_time(both, F.col("rank"))


def preliminary_range(obs: DataFrame) -> DataFrame:
    """First and last day to read again because rows are still preliminary.

    A series without preliminary rows has no row here: nothing to read.
    """
    days = obs.where(F.col("qc") == "p").withColumn("date", F.to_date("ts"))
    return preliminary_days(days.withColumn("preliminary", F.lit(True)))


def preliminary_days(daily: DataFrame) -> DataFrame:
    """`preliminary_range` from daily summaries, which are far smaller."""
    return (
        daily.where("preliminary")
        .groupBy(*KEYS)
        .agg(
            F.min("date").alias("start_date"),
            F.date_add(F.max("date"), 1).alias("end_date"),
        )
    )


def verified_rows(new: DataFrame, ranges: DataFrame) -> DataFrame:
    """New rows inside the preliminary range of their series, one per time."""
    day = F.to_date("ts")
    inside = new.join(ranges, KEYS).where((day >= F.col("start_date")) & (day <= F.col("end_date")))
    return one_per_time(inside)


def overlay_verified(
    obs: DataFrame, new: DataFrame, ranges: DataFrame | None = None
) -> DataFrame:
    """Stored rows with verified values laid over them.

    A new value or QC mark replaces the old one at the same time unless it is
    missing, so a missing verified value never erases a preliminary one while
    its QC mark still counts. `ranges` (`preliminary_days` of the daily table)
    saves a pass over the stored rows. Nothing runs before the result is asked
    for.
    """
    ranges = preliminary_range(obs) if ranges is None else ranges
    return lay_over(obs, verified_rows(new, ranges))


def changed_cells(obs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of `lay_over` that differ from what is stored, and no others."""
    pair = fresh.select(*_AT, F.col("value").alias("new_value"), F.col("qc").alias("new_qc"))
    differs = (
        F.col("new_value").isNotNull() & ~F.col("value").eqNullSafe(F.col("new_value"))
    ) | (F.col("new_qc").isNotNull() & ~F.col("qc").eqNullSafe(F.col("new_qc")))
    return obs.join(pair, _AT).where(differs).select(
        *_AT,
        F.coalesce("new_value", "value").alias("value"),
        F.coalesce("new_qc", "qc").alias("qc"),
    )


def lay_over(obs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the non-missing cells of `fresh` (one row per time)."""
    pair = fresh.select(*_AT, F.col("value").alias("new_value"), F.col("qc").alias("new_qc"))
    return obs.join(pair, _AT, "left").select(
        *_AT,
        F.coalesce("new_value", "value").alias("value"),
        F.coalesce("new_qc", "qc").alias("qc"),
    )


def unseen_rows(obs: DataFrame, new: DataFrame, append_key: str = "ts,variable") -> DataFrame:
    """New rows whose time, of their variable, the station does not hold yet.

    The stored side is only probed for the new times (a semi join with the
    small side as build side), and the anti join then works on small data.
    Both sides give each time once: readings that share one are counted
    together in their tasks and are neither sorted nor held for the join.
    """
    keys = APPEND_KEYS[append_key]
    stored, brought = obs.select(*keys).distinct(), new.select(*keys).distinct()
    return new.join(stored.join(brought, keys, "left_semi"), keys, "left_anti")


def append_new(obs: DataFrame, new: DataFrame, append_key: str = "ts,variable") -> DataFrame:
    """Stored rows plus the new rows at unseen times.

    A variable that arrives late for a known time is new. With
    ``append_key='ts'`` a time counts as seen once any variable has it, and the
    late variable is dropped.
    """
    return obs.unionByName(unseen_rows(obs, new, append_key).select(*obs.columns))


def has_new_data(obs: DataFrame, new: DataFrame, append_key: str = "ts,variable") -> DataFrame:
    """For each station in `new`: does it bring any unseen time?

    Only the different times are looked up, not the readings that share them.
    """
    times = new.select(*APPEND_KEYS[append_key]).distinct()
    stations = times.select(STATION).distinct()
    fresh = unseen_rows(obs, times, append_key).select(STATION).distinct()
    return stations.join(fresh.withColumn("has_new", F.lit(True)), STATION, "left").select(
        STATION, F.coalesce("has_new", F.lit(False)).alias("has_new")
    )


def inventory_gate(requested: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requested (station, product) pairs that the station offers."""
    return requested.join(inventory.select(STATION, "product"), [STATION, "product"], "left_semi")


def last_obs(obs: DataFrame) -> DataFrame:
    """Time of the last non-missing observation of each variable."""
    return (
        obs.where(F.col("value").isNotNull())
        .groupBy(*KEYS)
        .agg(F.max("ts").alias("last_obs"))
    )


def last_obs_of_days(daily: DataFrame) -> DataFrame:
    """`last_obs` from daily summaries, which are far smaller."""
    return (
        daily.where(F.col("last_obs").isNotNull())
        .groupBy(*KEYS)
        .agg(F.max("last_obs").alias("last_obs"))
    )


def fetch_plan(
    inventory: DataFrame,
    last: DataFrame,
    as_of: Column,
    start_date: str | None = None,
    end_date: str | None = None,
) -> DataFrame:
    """Date range to request for each variable a station offers.

    `inventory` has (station_id, variable, start_date), `last` the output of
    `last_obs` or the stored metadata. A first load starts at the inventory, a
    refresh at the last observation; both run through the day after `as_of`.
    """
    start = F.coalesce(F.to_date("last_obs"), F.to_date("start_date"))
    end = F.date_add(F.to_date(as_of), 1)
    if start_date is not None:
        start = F.to_date(F.lit(start_date))
    if end_date is not None:
        end = F.to_date(F.lit(end_date))
    return inventory.join(last.select(*KEYS, "last_obs"), KEYS, "left").select(
        *KEYS, format_date(start).alias("begin_date"), format_date(end).alias("end_date")
    )


def get_observations(
    obs: DataFrame, station_id: str | None = None, variable: str | None = None
) -> DataFrame:
    """The stored record, of one station or variable if named."""
    if station_id is not None:
        obs = obs.where(F.col(STATION) == station_id)
    if variable is not None:
        obs = obs.where(F.col(VARIABLE) == variable)
    return obs.select(*_AT, "value", "qc")


def get_variables(obs: DataFrame) -> DataFrame:
    """Variables of each station, from the readings themselves.

    For a stored record the manifest knows them (`stored_variables`).
    """
    return obs.select(*KEYS).distinct()
