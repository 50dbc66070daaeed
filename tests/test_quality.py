import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import AIR, LEVEL, brute_daily, day_rows, obs
from tidemark.operators import daily as D
from tidemark.operators import quality as Q
from tidemark.operators.spine import calendar_spine, densify
from tidemark.schemas import KEYS
from tidemark.sources.observations import write_bucketed


def days(df):
    return sorted(r.date.isoformat() for r in df.collect())


def test_day_gate_at_the_threshold(spark):
    rows = day_rows("s", AIR, "2020-01-01", range(20)) + day_rows("s", AIR, "2020-01-02", range(19))
    daily = Q.daily_table(obs(spark, rows))
    assert {r.date.day: (r.n_hours, r.good_day) for r in daily.collect()} == {
        1: (20, True),
        2: (19, False),
    }


def test_missing_and_fill_values_are_no_hours(spark):
    rows = day_rows("s", AIR, "2020-01-01", range(20))
    rows[0] = ("s", AIR, "2020-01-01 00:00", None)
    rows[1] = ("s", AIR, "2020-01-01 01:00", 31.8)
    rows[2] = ("s", AIR, "2020-01-01 02:00", float("nan"))
    # A second reading rescues one of the hours.
    rows.append(("s", AIR, "2020-01-01 01:30", 7.0))
    row = Q.daily_table(obs(spark, rows)).first()
    assert (row.n_hours, row.good_day, row.high, row.low) == (18, False, 7.0, 1.0)


def test_fill_value_can_be_kept(spark):
    o = obs(spark, [("s", LEVEL, "2020-01-01 00:00", 31.8), ("s", AIR, "2020-01-01 00:00", 31.8)])
    got = {r.variable: r.high for r in Q.daily_summary(o, fill_variables=[AIR]).collect()}
    assert got == {LEVEL: 31.8, AIR: None}


def test_gates_are_per_variable(spark):
    rows = day_rows("s", AIR, "2020-01-01", range(24)) + day_rows("s", LEVEL, "2020-01-01", range(5))
    got = {r.variable: r.good_day for r in Q.daily_table(obs(spark, rows)).collect()}
    assert got == {AIR: True, LEVEL: False}


def february(n_good, n_bad=0):
    rows = []
    for d in range(1, n_good + 1):
        rows += day_rows("s", AIR, f"2021-02-{d:02d}", range(24), float(d))
    for d in range(n_good + 1, n_good + n_bad + 1):
        rows += day_rows("s", AIR, f"2021-02-{d:02d}", range(3), 99.0)
    return rows


def test_month_gate_counts_good_days_only(spark):
    for n_good, n_bad, good in ((26, 0, True), (25, 0, False), (25, 3, False), (26, 2, True)):
        daily = Q.daily_table(obs(spark, february(n_good, n_bad)))
        assert {r.good_month for r in daily.collect()} == {good}
        months = D.month_series(daily, day_threshold=2).collect()
        assert len(months) == int(good)
        if good:
            assert months[0].high == 26.0 and months[0].n_days == n_good


def test_filters_drop_rows_of_bad_days_and_months(spark):
    rows = february(26, 2) + day_rows("s", AIR, "2021-03-05", range(24), 5.0)
    o = obs(spark, rows)
    by_day = Q.filter_days_by_hours(o)
    assert by_day.count() == 27 * 24
    assert by_day.columns == o.columns
    by_month = Q.filter_months_by_days(o)
    assert by_month.count() == 26 * 24
    assert by_month.agg(F.max("ts")).first()[0] == dt.datetime(2021, 2, 26, 23)


def test_series_and_averages(spark):
    rows = day_rows("s", AIR, "2020-01-01", range(24), 1.0)
    rows[5] = ("s", AIR, "2020-01-01 05:00", 11.0)
    daily = Q.daily_table(obs(spark, rows))
    assert D.daily_highs(daily).first().high == 11.0
    assert D.daily_lows(daily).first().low == 1.0
    assert D.daily_avgs(daily).first().average == 6.0
    assert abs(D.daily_avgs(daily, "mean").first().average - 34 / 24) < 1e-12
    assert D.mon_daily_highs(daily).count() == 0


def test_raising_a_threshold_removes_no_day(spark):
    rows = [r for d in range(1, 11) for r in day_rows("s", AIR, f"2020-01-{d:02d}", range(d * 2))]
    daily = Q.daily_summary(obs(spark, rows))
    kept = [set(days(Q.good_day(daily, t).where("good_day"))) for t in (0, 4, 8, 23)]
    assert all(a <= b for a, b in zip(kept, kept[1:]))
    assert [len(k) for k in kept] == [0, 1, 3, 10]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.integers(0, 3),
            st.integers(0, 23),
            st.integers(0, 9),
            st.sampled_from([None, 31.8, float("nan"), 1.0, 2.5, -3.0]),
        ),
        min_size=1,
        max_size=150,
    )
)
def test_daily_table_against_brute_force(spark, readings):
    rows = [("s", AIR, f"2020-01-{d + 1:02d} {h:02d}:{m * 6:02d}", v) for d, h, m, v in readings]
    o = obs(spark, rows)
    want = brute_daily(o.toPandas(), hr_threshold=18)
    daily = Q.daily_table(o, hr_threshold=18)
    got = D.daily_highs(daily).join(D.daily_lows(daily), [*KEYS, "date"]).collect()
    assert sorted((r.date, r.high, r.low) for r in got) == sorted(
        want.itertuples(index=False, name=None)
    )


def test_densify_bounds(spark):
    df = spark.createDataFrame([("a", 3, 30.0), ("a", 5, 50.0), ("b", 9, 90.0)], "k string, i int, v double")

    def got(**kw):
        rows = densify(df, ["k"], "i", **kw).collect()
        return sorted((r.k, r.i, r.v) for r in rows)

    assert got() == [("a", 3, 30.0), ("a", 4, None), ("a", 5, 50.0), ("b", 9, 90.0)]
    assert got(start=4, stop=6) == [
        ("a", 4, None),
        ("a", 5, 50.0),
        ("a", 6, None),
        ("b", 4, None),
        ("b", 5, None),
        ("b", 6, None),
    ]
    # A key with all rows before the axis still gets the whole axis.
    assert [r for r in got(start=6, stop=7) if r[0] == "a"] == [("a", 6, None), ("a", 7, None)]


def test_calendar_spine(spark):
    df = spark.createDataFrame(
        [("s", AIR, dt.date(2020, 2, 28), 1.0), ("s", AIR, dt.date(2020, 3, 2), 2.0)],
        "station_id string, variable string, date date, high double",
    )
    daily = sorted((r.date.isoformat(), r.high) for r in calendar_spine(df, KEYS).collect())
    assert daily == [
        ("2020-02-28", 1.0),
        ("2020-02-29", None),
        ("2020-03-01", None),
        ("2020-03-02", 2.0),
    ]
    months = df.withColumn("date", F.trunc("date", "month"))
    assert calendar_spine(months, KEYS, unit="month").count() == 2


def test_gates_of_bucketed_readings_shuffle_nothing(spark, tmp_path):
    """Readings bucketed by series and month: one scan, no exchange, the same rows."""
    o = obs(spark, [
        r for s in "12" for m in (1, 2) for d in range(1, 29 if m == 2 else 32)
        for r in day_rows(s, AIR, f"2021-{m:02d}-{d:02d}", range(24 if s == "1" or d > 3 else 12), 1.0 + d)])
    table = write_bucketed(o, "bucketed_readings", str(tmp_path / "b"), 4)
    try:
        for gate in (Q.filter_days_by_hours, Q.filter_months_by_days):
            got = gate(table)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("FileScan") == 1
            want = sorted(map(tuple, gate(o).collect()))
            assert sorted(map(tuple, got.select(*o.columns).collect())) == want
            daily = Q.daily_summary(o)
            assert sorted(map(tuple, gate(o, daily=daily).collect())) == want
            assert 0 < len(want) < o.count()
    finally:
        spark.sql("DROP TABLE bucketed_readings")
