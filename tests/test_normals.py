import datetime as dt
import random

from tests.helpers import AIR, LEVEL, brute_year_of, daily_frame
from tidemark.operators import normals as S
from tidemark.schemas import DAILY_STATS, MONTHLY_STATS


def one(df, **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1
    return rows[0]


def test_ties_go_to_the_earliest_year(spark):
    rows = [("s", AIR, f"{y}-06-01", h, lo) for y, h, lo in
            ((2003, 9.0, 1.0), (2001, 9.0, 1.0), (2002, 5.0, 4.0), (2004, 5.0, 4.0))]
    d = daily_frame(spark, rows)
    r = S.record_daily_high(d).first()
    assert (r.record_high, r.record_high_year) == (9.0, 2001)
    r = S.lowest_daily_high(d).first()
    assert (r.lowest_high, r.lowest_high_year) == (5.0, 2002)
    r = S.record_daily_low(d).first()
    assert (r.record_low, r.record_low_year) == (1.0, 2001)
    r = S.highest_daily_low(d).first()
    assert (r.highest_low, r.highest_low_year) == (4.0, 2002)


def test_missing_days_take_no_part(spark):
    d = daily_frame(spark, [("s", AIR, "2001-06-01", None, None), ("s", AIR, "2002-06-01", -5.0, -9.0)])
    r = one(S.daily_stats(d), date_label="01-Jun")
    assert (r.record_high, r.record_high_year, r.lowest_high, r.lowest_high_year) == (-5.0, 2002, -5.0, 2002)
    assert (r.record_low, r.record_low_year, r.years) == (-9.0, 2002, 1)


def test_daily_stats_layout(spark):
    d = daily_frame(spark, [("s", AIR, "2001-03-01", 4.0, 2.0), ("s", AIR, "2004-02-29", 8.0, 2.0)])
    table = S.daily_stats(d)
    assert table.columns == ["station_id", "variable", "yearday", "date_label", *DAILY_STATS]
    rows = table.orderBy("yearday").collect()
    assert len(rows) == 366
    assert rows[59].date_label == "29-Feb" and rows[59].daily_average == 5.0
    assert rows[60].date_label == "01-Mar" and rows[60].daily_average == 3.0
    assert rows[0].daily_average is None and rows[0].years is None


def random_days(seed):
    rng = random.Random(seed)
    start = dt.date(1999, 1, 1)
    rows = []
    for i in range(0, 1500):
        day = start + dt.timedelta(days=i)
        for v in (AIR, LEVEL):
            if rng.random() < 0.97:
                low = float(rng.randint(-3, 3))
                rows.append(("s", v, day.isoformat(), low + rng.randint(0, 4), low))
    return rows


def yearday(day):
    leap = dt.date(2020, day.month, day.day)
    return leap.timetuple().tm_yday


def test_daily_stats_against_brute_force(spark):
    rows = random_days(1)
    got = {(r.variable, r.yearday): r for r in S.daily_stats(daily_frame(spark, rows)).collect()}
    groups = {}
    for _, v, day, high, low in rows:
        d = dt.date.fromisoformat(day)
        groups.setdefault((v, yearday(d)), []).append((d.year, high, low))
    for key, members in groups.items():
        r = got[key]
        highs = [(y, h) for y, h, _ in members]
        lows = [(y, lo) for y, _, lo in members]
        mids = [(y, (h + lo) / 2) for y, h, lo in members]
        assert (r.record_high, r.record_high_year) == brute_year_of(highs, max)
        assert (r.lowest_high, r.lowest_high_year) == brute_year_of(highs, min)
        assert (r.highest_low, r.highest_low_year) == brute_year_of(lows, max)
        assert (r.record_low, r.record_low_year) == brute_year_of(lows, min)
        assert (r.record_high_daily_average, r.record_high_daily_average_year) == brute_year_of(mids, max)
        assert (r.record_low_daily_average, r.record_low_daily_average_year) == brute_year_of(mids, min)
        assert abs(r.daily_average - sum(m for _, m in mids) / len(mids)) < 1e-9
        assert r.years == len({y for y, _ in highs})
        assert r.record_low <= r.highest_low and r.lowest_high <= r.record_high


def test_monthly_stats_against_brute_force(spark):
    rows = random_days(2)
    table = S.monthly_stats(daily_frame(spark, rows), day_threshold=2)
    assert table.columns == ["station_id", "variable", "month", "month_label", *MONTHLY_STATS]
    got = {(r.variable, r.month): r for r in table.collect()}
    assert len(got) == 24
    months = {}
    for _, v, day, high, low in rows:
        d = dt.date.fromisoformat(day)
        months.setdefault((v, d.year, d.month), []).append((high + low) / 2)
    groups = {}
    for (v, y, m), mids in months.items():
        length = ((dt.date(y, m, 28) + dt.timedelta(days=4)).replace(day=1) - dt.date(y, m, 1)).days
        if len(mids) >= length - 2:
            groups.setdefault((v, m), []).append((y, sum(mids) / len(mids), max(mids), min(mids)))
    for key, r in got.items():
        members = groups.get(key, [])
        if not members:
            assert r.years is None
            continue
        assert r.years == len(members)
        assert abs(r.monthly_average - sum(x[1] for x in members) / len(members)) < 1e-9
        assert (r.record_high, r.record_high_year) == brute_year_of([(x[0], x[2]) for x in members], max)
        assert (r.lowest_high, r.lowest_high_year) == brute_year_of([(x[0], x[2]) for x in members], min)
        assert (r.highest_low, r.highest_low_year) == brute_year_of([(x[0], x[3]) for x in members], max)
        assert (r.record_low, r.record_low_year) == brute_year_of([(x[0], x[3]) for x in members], min)
        high, year = brute_year_of([(x[0], x[1]) for x in members], max)
        assert abs(r.record_high_monthly_average - high) < 1e-9
        assert r.record_high_monthly_average_year == year


def test_single_statistics_agree_with_the_table(spark):
    d = daily_frame(spark, random_days(3)[:600])
    table = {(r.variable, r.yearday): r for r in S.daily_stats(d).collect()}
    for fn in (S.daily_avg, S.record_high_daily_avg, S.record_low_daily_avg, S.avg_daily_high,
               S.avg_daily_low, S.number_of_years_byday):
        for r in fn(d).collect():
            for c in r.asDict():
                assert r[c] == table[(r.variable, r.yearday)][c]


def test_data_range(spark):
    d = daily_frame(spark, random_days(4))
    daily = one(S.data_range(d), variable=AIR)
    monthly = one(S.data_range(d, "monthly"), variable=AIR)
    assert daily.start_date <= monthly.start_date <= monthly.end_date <= daily.end_date
