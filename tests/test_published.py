import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import AIR, LEVEL, daily_frame
from tests.test_normals import random_days
from tidemark.dimensions import station_units
from tidemark.operators import analysis as A
from tidemark.operators import published as P
from tidemark.operators.normals import daily_stats, data_range, monthly_stats
from tidemark.schemas import DAILY_STATS, record_names


def stats_of(spark, rows):
    return daily_stats(daily_frame(spark, rows))


BASE = [
    ("s", AIR, "2000-06-01", 10.0, 2.0),
    ("s", AIR, "2001-06-01", 8.0, 4.0),
    ("s", LEVEL, "2000-06-01", 1.234, 0.5),
]


def test_select_variable(spark):
    one = P.select_variable(stats_of(spark, BASE), AIR)
    assert one.count() == 366 and "variable" not in one.columns


def test_new_records(spark):
    old = stats_of(spark, BASE)
    new = stats_of(spark, BASE + [("s", AIR, "2002-06-01", 12.0, 4.0)])
    units = station_units(old)
    found = {r.record: r for r in P.new_records(old, new, units).collect()}
    # Mid 8.0 beats 6.0; high 12 beats 10. The highest low 4.0 stays with 2001.
    assert set(found) == {"record_high", "record_high_daily_average"}
    r = found["record_high"]
    assert (r.value, r.year, r.old_value, r.old_year) == (12.0, 2002, 10.0, 2000)
    assert r.message == "Record high of air temperature on 01-Jun is 12.0 °F (2002), was 10.0 °F (2000)"


def test_new_records_same_year_and_first_time(spark):
    old = stats_of(spark, [("s", AIR, "2000-06-01", 10.0, 2.0)])
    new = stats_of(spark, [("s", AIR, "2000-06-01", 11.0, 2.0), ("s", AIR, "2000-06-02", 1.0, 1.0)])
    found = {(r.date_label, r.record): r for r in P.new_records(old, new).collect()}
    r = found["01-Jun", "record_high"]
    assert (r.year, r.old_year) == (2000, 2000)
    assert r.message == "Record high of air temperature on 01-Jun is 11.0 (2000), was 10.0 (2000)"
    first = found["02-Jun", "record_low"]
    assert first.old_value is None and "was nan (nan)" in first.message


def test_tiny_change_of_an_extreme_is_a_change(spark):
    old = stats_of(spark, [("s", AIR, "2000-06-01", 10.0, 5.0)])
    new = stats_of(spark, [("s", AIR, "2000-06-01", 10.0 + 1e-12, 5.0)])
    assert {r.record for r in P.new_records(old, new).collect()} == {"record_high", "lowest_high"}
    assert P.stats_changed(old, new).first().changed


def test_new_records_year_only_has_no_message(spark):
    old = stats_of(spark, [("s", AIR, "2001-06-01", 10.0, 10.0)])
    new = stats_of(spark, [("s", AIR, "2000-06-01", 10.0, 10.0), ("s", AIR, "2001-06-01", 10.0, 10.0)])
    rows = P.new_records(old, new).collect()
    assert {r.year for r in rows} == {2000} and {r.message for r in rows} == {None}


def test_stats_changed(spark):
    old = stats_of(spark, BASE + [("t", AIR, "2000-06-01", 1.0, 0.0)])
    new = stats_of(spark, BASE + [("t", AIR, "2000-06-01", 1.0, -1.0)])
    assert {r.station_id: r.changed for r in P.stats_changed(old, new).collect()} == {"s": False, "t": True}
    # Another order of summation is not a change; a new or lost variable is.
    noisy = old.withColumn("daily_average", F.col("daily_average") * (1 + 1e-15))
    assert not any(r.changed for r in P.stats_changed(old, noisy).collect())
    less = old.where(F.col("variable") == AIR)
    assert {r.station_id: r.changed for r in P.stats_changed(old, less).collect()} == {"s": True, "t": False}


def test_thresholds_and_current_year(spark):
    stats = stats_of(spark, BASE)
    levels = spark.createDataFrame(
        [("s", "major", 3.0), ("s", "minor", 1.0), ("x", "major", 9.0)], "station_id string, level string, value double")
    r = P.attach_thresholds(stats, levels).first()
    assert (r.variable, r.major_threshold, r.moderate_threshold, r.minor_threshold) == (LEVEL, 3.0, None, 1.0)
    r = P.current_year_records(stats, 2000).where("date_label = '01-Jun' and variable = 'Air Temperature'").first()
    assert (r.high_records, r.low_records) == (10.0, 2.0)


def test_drop_empty_stats(spark):
    stats = P.current_year_records(stats_of(spark, BASE), 1950)
    kept = P.drop_empty_stats(stats, P.count_filled(stats))
    assert "high_records" not in kept.columns and "record_high" in kept.columns


def test_yesterday(spark):
    d = daily_frame(spark, BASE)
    rows = P.yesterday_summary(d, F.lit("2000-06-02")).collect()
    assert {r.variable: (r.average, r.high, r.low) for r in rows}[AIR] == (6.0, 10.0, 2.0)
    assert P.yesterday_summary(d.withColumn("good_day", F.lit(False)), F.lit("2000-06-02")).isEmpty()


def test_metadata_fixture_average_is_midrange(spark):
    d = daily_frame(spark, [("s", AIR, "2020-01-01", 88.3, 85.1)])
    assert abs(P.yesterday_summary(d, F.lit("2020-01-02")).first().average - 86.7) < 1e-9


# --- counting ---


@pytest.mark.parametrize("kind", ["daily", "monthly"])
def test_record_counts_against_brute_force(spark, kind):
    d = daily_frame(spark, random_days(11))
    stats = daily_stats(d) if kind == "daily" else monthly_stats(d)
    names = record_names(stats.columns)
    want = {}
    for r in stats.collect():
        for n in names:
            if r[f"{n}_year"] is not None:
                want[(r.variable, r[f"{n}_year"], n)] = want.get((r.variable, r[f"{n}_year"], n), 0) + 1
    counts = A.record_counts(stats).collect()
    for r in counts:
        for n in names:
            assert r[n] == want.get((r.variable, r.year, n), 0)
    assert sum(r[n] for r in counts for n in names) == sum(want.values())
    set_rows = A.daily_records_set(stats).collect()
    assert all(sum(r[n] for n in names) > 0 for r in set_rows)


def test_record_counts_fill_empty_years(spark):
    stats = stats_of(spark, [("s", AIR, "2000-06-01", 1.0, 0.0), ("s", AIR, "2004-06-02", 1.0, 0.0)])
    rows = A.record_counts(stats).orderBy("year").collect()
    assert [(r.year, r.record_high) for r in rows] == [(2000, 1), (2001, 0), (2002, 0), (2003, 0), (2004, 1)]
    assert [r.year for r in A.daily_records_set(stats).orderBy("year").collect()] == [2000, 2004]
    series = A.annual_record_series(stats, 2005, 1999).where("record = 'record_low'").orderBy("year")
    assert [r.n_records for r in series.collect()] == [0, 1, 0, 0, 0, 1, 0]
    old = stats_of(spark, [("s", AIR, "1950-06-01", 1.0, 0.0)])
    years = A.annual_record_series(old, 1952).where("record = 'record_low'").orderBy("year").collect()
    assert [(r.year, r.n_records) for r in years] == [(1950, 1), (1951, 0), (1952, 0)]


def test_this_and_last_year_and_flags(spark):
    stats = stats_of(spark, BASE)
    r = A.records_this_and_last_year(stats, 2001).where(F.col("variable") == AIR).first()
    # 2001 holds the lowest high and the highest low; both mids are 6.0 and stay with 2000.
    assert (r.this_year, r.last_year) == (2, 4)
    flags = A.record_row_flags(stats, 2001).where("date_label = '01-Jun' and variable = 'Air Temperature'").first()
    assert flags.lowest_high_is_new and flags.highest_low_is_new and not flags.record_high_is_new


def test_stats_table_and_header(spark):
    d = daily_frame(spark, BASE)
    stats = daily_stats(d)
    table = A.stats_table(stats, data_range(d), LEVEL).where("date_label = '01-Jun'").first()
    assert (table.record_high, table.subtitle) == (1.23, "Readings of 6/1/2000 - 6/1/2000")
    assert A.stats_table(stats, data_range(d), "Salinity").isEmpty()
    wanted = spark.createDataFrame([("s", AIR), ("s", "Salinity")], "station_id string, variable string")
    text = {r.variable: r.heading for r in A.table_header(wanted, stats, 2001).collect()}
    assert text[AIR] == "air temperature, daily records: 2 from this year, 4 from the year before"
    assert text["Salinity"] == "salinity: no daily statistics here"


def test_today_value(spark):
    stats = stats_of(spark, BASE)
    rows = A.today_value(stats, station_units(stats), F.lit(dt.date(2024, 6, 1)), "record_high").collect()
    assert {r.variable: r.value for r in rows} == {AIR: "10.0 °F", LEVEL: "1.2 ft"}


def test_axis_bounds(spark):
    rows = {r.variable: (r.y_min, r.y_max) for r in A.axis_bounds(stats_of(spark, BASE)).collect()}
    assert rows == {AIR: (0.0, 20.0), LEVEL: (0.0, 10.0)}


def test_widened_history_never_lowers_a_record(spark):
    rows = random_days(5)
    random.Random(0).shuffle(rows)
    few = {(r.variable, r.yearday): r for r in stats_of(spark, rows[:1500]).collect()}
    for r in stats_of(spark, rows).collect():
        before = few.get((r.variable, r.yearday))
        if before is not None and before.record_high is not None:
            assert r.record_high >= before.record_high and r.record_low <= before.record_low
    assert DAILY_STATS[-1] == "years"
