import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import AIR, LEVEL, obs
from tidemark.operators import combine as C
from tidemark.schemas import OBSERVATIONS


def got(df):
    return sorted(
        ((r.station_id, r.variable, r.ts.isoformat(" ", "minutes"), r.value, r.qc) for r in df.collect()),
        key=repr,
    )


def test_assemble_takes_the_union_of_times(spark):
    o = obs(spark, [
        ("s", AIR, "2020-01-01 00:00", 1.0),
        ("s", LEVEL, "2020-01-01 00:00", 2.0, "v"),
        ("s", LEVEL, "2020-01-01 01:00", 3.0, "p"),
        ("t", AIR, "2020-01-01 01:00", 4.0),
    ])
    wide = C.assemble_variables(o, [AIR, LEVEL]).orderBy("station_id", "ts")
    assert wide.columns == ["station_id", "ts", AIR, LEVEL, f"{LEVEL} QC"]
    assert [tuple(r)[2:] for r in wide.collect()] == [
        (1.0, 2.0, "v"), (None, 3.0, "p"), (4.0, None, None)]


def test_splice_hourly_wins_and_loses_its_last_row(spark):
    hourly = obs(spark, [
        ("s", LEVEL, "2020-01-01 22:00", 1.0, "v"),
        ("s", LEVEL, "2020-01-01 23:00", 2.0, "v"),
        ("s", LEVEL, "2020-01-02 00:00", None, None),
        ("s", LEVEL, "2020-01-02 01:00", 4.0, "v"),
        ("s", LEVEL, "2020-01-03 23:00", 5.0, "v"),
        ("s", LEVEL, "2020-01-04 00:00", 6.0, "v"),
    ])
    levels = obs(spark, [
        ("s", LEVEL, "2020-01-02 00:00", 30.0, "p"),
        ("s", LEVEL, "2020-01-02 00:06", 30.6, "p"),
        ("s", LEVEL, "2020-01-02 01:00", 31.0, "p"),
        ("s", LEVEL, "2020-01-03 23:00", 32.0, "p"),
    ])
    # 4 Jan lies beyond the day after the first level; 3 Jan 23:00 is the last row.
    assert got(C.splice_hourly(hourly, levels)) == [
        ("s", LEVEL, "2020-01-01 22:00", 1.0, "v"),
        ("s", LEVEL, "2020-01-01 23:00", 2.0, "v"),
        ("s", LEVEL, "2020-01-02 00:00", None, None),
        ("s", LEVEL, "2020-01-02 00:06", 30.6, "p"),
        ("s", LEVEL, "2020-01-02 01:00", 4.0, "v"),
        ("s", LEVEL, "2020-01-03 23:00", 32.0, "p"),
    ]


def test_splice_without_levels_keeps_the_hours(spark):
    hourly = obs(spark, [("s", LEVEL, f"2020-01-01 {h:02d}:00", 1.0, "v") for h in range(3)])
    assert C.splice_hourly(hourly, obs(spark, [])).count() == 2


OLD = [
    ("s", LEVEL, "2020-01-01 00:00", 1.0, "v"),
    ("s", LEVEL, "2020-01-02 00:00", 2.0, "p"),
    ("s", LEVEL, "2020-01-02 01:00", 3.0, "p"),
    ("s", LEVEL, "2020-01-03 00:00", 4.0, "p"),
    ("s", LEVEL, "2020-01-05 00:00", 5.0, "v"),
    ("s", AIR, "2020-01-02 00:00", 9.0, None),
]


def test_overlay_replaces_by_what_is_there(spark):
    new = obs(spark, [
        ("s", LEVEL, "2020-01-01 00:00", 10.0, "v"),
        ("s", LEVEL, "2020-01-02 00:00", 20.0, "v"),
        ("s", LEVEL, "2020-01-02 01:00", None, "v"),
        ("s", LEVEL, "2020-01-05 00:00", 50.0, "v"),
        ("s", LEVEL, "2020-01-02 02:00", 60.0, "v"),
    ])
    ranges = C.preliminary_range(obs(spark, OLD)).collect()
    assert [(r.start_date, r.end_date) for r in ranges] == [(dt.date(2020, 1, 2), dt.date(2020, 1, 4))]
    assert got(C.overlay_verified(obs(spark, OLD), new)) == sorted([
        ("s", LEVEL, "2020-01-01 00:00", 1.0, "v"),
        ("s", LEVEL, "2020-01-02 00:00", 20.0, "v"),
        ("s", LEVEL, "2020-01-02 01:00", 3.0, "v"),
        ("s", LEVEL, "2020-01-03 00:00", 4.0, "p"),
        ("s", LEVEL, "2020-01-05 00:00", 5.0, "v"),
        ("s", AIR, "2020-01-02 00:00", 9.0, None),
    ], key=repr)


def test_overlay_without_preliminary_rows_changes_nothing(spark):
    old = obs(spark, OLD[:1])
    new = obs(spark, [("s", LEVEL, "2020-01-01 00:00", 10.0, "v")])
    assert got(C.overlay_verified(old, new)) == got(old)


def test_append_by_time_drops_a_late_variable(spark):
    old = obs(spark, [("s", AIR, "2020-01-01 00:00", 1.0)])
    new = obs(spark, [
        ("s", AIR, "2020-01-01 00:00", 5.0),
        ("s", LEVEL, "2020-01-01 00:00", 2.0, "v"),
        ("s", LEVEL, "2020-01-01 01:00", 3.0, "v"),
        ("t", AIR, "2020-01-01 00:00", 4.0),
    ])
    assert C.append_new(old, new, "ts").count() == 3
    assert C.append_new(old, new).count() == 4
    assert {r.station_id: r.has_new for r in C.has_new_data(old, new).collect()} == {"s": True, "t": True}
    assert not C.has_new_data(old, old).first().has_new


@pytest.mark.parametrize("key", ["ts", "ts,variable"])
def test_a_time_is_looked_up_once_however_many_readings_share_it(spark, key):
    old = obs(spark, [("s", AIR, "2020-01-01 00:00", float(i)) for i in range(9)])
    new = obs(spark, [("s", v, f"2020-01-01 {h:02d}:00", float(i)) for v in (AIR, LEVEL) for h in (0, 1) for i in range(9)])
    unseen = C.unseen_rows(old, new, key)
    assert unseen.count() == {"ts": 18, "ts,variable": 27}[key]
    lines = unseen._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    depth = lines[at].index("Join") + 3
    sides = [line for line in lines[at + 1 :] if line[depth - 3 : depth] in (":- ", "+- ")][:2]
    assert [line[depth:].split()[0] for line in sides] == ["Aggregate", "Aggregate"], "readings, not times, are joined"


def test_unknown_times_and_stations_stay_new(spark):
    rows = [("s", AIR, dt.datetime(2020, 1, 1), 1.0, None), ("s", AIR, None, 2.0, None), (None, AIR, dt.datetime(2020, 1, 1), 3.0, None)]
    o = spark.createDataFrame(rows, OBSERVATIONS)
    assert sorted(r.value for r in C.unseen_rows(o, o).collect()) == [2.0, 3.0]
    assert {r.station_id: r.has_new for r in C.has_new_data(o, o, "ts").collect()} == {"s": True, None: False}


def test_get_and_last(spark):
    o = obs(spark, OLD + [("s", LEVEL, "2020-01-09 00:00", None, "p")])
    assert C.get_observations(o, "s", AIR).count() == 1
    assert C.get_variables(o).count() == 2
    last = {r.variable: r.last_obs for r in C.last_obs(o).collect()}
    assert last[LEVEL] == dt.datetime(2020, 1, 5)


def test_fetch_plan(spark):
    inventory = spark.createDataFrame(
        [("s", LEVEL, dt.date(1990, 1, 1)), ("s", AIR, dt.date(1994, 2, 3))],
        "station_id string, variable string, start_date date")
    last = C.last_obs(obs(spark, OLD[:5]))
    as_of = F.lit("2020-02-28").cast("date")

    def plan(**kw):
        rows = C.fetch_plan(inventory, last, as_of, **kw).collect()
        return {r.variable: (r.begin_date, r.end_date) for r in rows}

    assert plan() == {LEVEL: ("20200105", "20200229"), AIR: ("19940203", "20200229")}
    assert plan(start_date="2019-01-01", end_date="2019-02-01")[AIR] == ("20190101", "20190201")


def test_inventory_gate(spark):
    wanted = spark.createDataFrame([("s", "Wind"), ("s", AIR), ("t", AIR)], "station_id string, product string")
    held = spark.createDataFrame([("s", AIR, 1), ("t", "Wind", 1)], "station_id string, product string, x int")
    assert [tuple(r) for r in C.inventory_gate(wanted, held).collect()] == [("s", AIR)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    old=st.dictionaries(st.tuples(st.sampled_from([AIR, LEVEL]), st.integers(0, 9)), st.floats(-5, 5), max_size=12),
    new=st.dictionaries(st.tuples(st.sampled_from([AIR, LEVEL]), st.integers(0, 9)), st.floats(-5, 5), max_size=12),
)
def test_append_against_brute_force(spark, old, new):
    def rows(d):
        return [("s", v, f"2020-01-01 {h:02d}:00", x) for (v, h), x in d.items()]

    seen = {h for _, h in old}
    want = rows(old) + rows({k: x for k, x in new.items() if k[1] not in seen})
    result = C.append_new(obs(spark, rows(old)), obs(spark, rows(new)), "ts")
    assert [r[:4] for r in got(result)] == sorted(want, key=repr)


def test_one_reading_per_time_prefers_verified_then_present(spark):
    rows = [
        ("s", LEVEL, "2020-01-01 00:00", 4.0, "p"), ("s", LEVEL, "2020-01-01 00:00", 40.0, "v"),
        ("s", LEVEL, "2020-01-01 01:00", None, "p"), ("s", LEVEL, "2020-01-01 01:00", 7.0, "v"),
        ("s", LEVEL, "2020-01-01 02:00", None, "p"), ("s", LEVEL, "2020-01-01 02:00", 5.0, "p"),
    ]
    got = {r.ts.hour: (r.value, r.qc) for r in C.one_per_time(obs(spark, rows)).collect()}
    assert got == {0: (40.0, "v"), 1: (7.0, "v"), 2: (5.0, "p")}
    wide = {r.ts.hour: (r[LEVEL], r[f"{LEVEL} QC"]) for r in C.assemble_variables(obs(spark, rows), [LEVEL]).collect()}
    assert wide == got
