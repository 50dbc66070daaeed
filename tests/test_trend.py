import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import AIR, LEVEL, daily_frame
from tidemark.operators import curves as V
from tidemark.operators import trend as R
from tidemark.operators.normals import daily_stats, monthly_stats


def month(i, first=(1990, 1)):
    n = first[0] * 12 + first[1] - 1 + i
    return dt.date(n // 12, n % 12 + 1, 1)


def series(spark, values, variable=LEVEL, station="s"):
    rows = [(station, variable, month(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, variable string, month_start date, value double")


def numpy_trend(values, period=4):
    """Independent reading of the definition."""
    y = np.array([np.nan if v is None else v for v in values], dtype=float)
    n = np.arange(len(y))
    ok = ~np.isnan(y)
    filled = np.interp(n, n[ok], y[ok])
    lo, hi = filled.min(), filled.max()
    norm = (filled - lo) / (hi - lo)
    if period % 2 == 0:
        w = np.r_[0.5, np.ones(period - 1), 0.5] / period
    else:
        w = np.ones(period) / period
    half = len(w) // 2
    smooth = np.full(len(y), np.nan)
    smooth[half : len(y) - half] = np.convolve(norm, w, mode="valid")
    phases = np.array([np.nanmean((norm - smooth)[j::period]) for j in range(period)])
    seasonal = np.resize(phases - phases.mean(), len(y))
    deseasoned = (norm - seasonal) * (hi - lo) + lo
    slope, intercept = np.polyfit(n, deseasoned, 1)
    return filled, norm, deseasoned, slope, intercept


def chain(df, period=4):
    s = R.interpolate_gaps(R.row_index(R.trim_ends(df)))
    return R.mask_interpolated(R.linear_trend(R.deseasonalise(s, period=period)))


RNG = np.random.default_rng(7)
CASES = {
    "line": [0.01 * i + [0.3, -0.1, -0.4, 0.2][i % 4] for i in range(48)],
    "gaps": [None if i in (5, 6, 17, 30) else 0.02 * i + math.sin(i) for i in range(60)],
    "random": [float(x) for x in RNG.normal(size=120)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("period", [4, 3, 12])
def test_trend_against_numpy(spark, name, period):
    values = CASES[name]
    filled, _, deseasoned, slope, intercept = numpy_trend(values, period)
    rows = chain(series(spark, values), period).orderBy("rownum").collect()
    assert np.allclose([r.linear_fill for r in rows], filled, atol=1e-12)
    assert np.allclose([r.deseasoned for r in rows], deseasoned, atol=1e-10)
    assert abs(rows[0].slope - slope) < 1e-11 and abs(rows[0].intercept - intercept) < 1e-10
    assert [r.masked is None for r in rows] == [v is None for v in values]


def test_line_with_season_gives_its_slope(spark):
    assert abs(chain(series(spark, CASES["line"])).first().slope - 0.01) < 1e-12


def test_normalise_matches_numpy_and_constant_is_null(spark):
    s = R.interpolate_gaps(R.row_index(series(spark, CASES["gaps"])))
    got = [r.normalised for r in R.minmax_normalise(s).orderBy("rownum").collect()]
    assert np.allclose(got, numpy_trend(CASES["gaps"])[1])
    flat = R.interpolate_gaps(R.row_index(series(spark, [2.0, 2.0])))
    assert {r.normalised for r in R.minmax_normalise(flat).collect()} == {None}


def test_trim_ends(spark):
    rows = R.row_index(R.trim_ends(series(spark, [None, 1.0, None, 2.0, None]))).orderBy("rownum").collect()
    assert [(r.rownum, r.value) for r in rows] == [(0, 1.0), (1, None), (2, 2.0)]


def test_monthly_series_spans_the_station(spark):
    def days(variable, y, m):
        length = (dt.date(y + m // 12, m % 12 + 1, 1) - dt.date(y, m, 1)).days
        return [("s", variable, dt.date(y, m, d).isoformat(), 2.0, 0.0) for d in range(1, length + 1)]

    d = daily_frame(spark, days(AIR, 2000, 1) + days(AIR, 2000, 4) + days(LEVEL, 2000, 3))
    rows = R.monthly_series(d).orderBy("variable", "month_start").collect()
    assert [(r.variable, r.month_start.month, r.value) for r in rows] == [
        (AIR, 1, 1.0), (AIR, 2, None), (AIR, 3, None), (AIR, 4, 1.0),
        (LEVEL, 1, None), (LEVEL, 2, None), (LEVEL, 3, 1.0), (LEVEL, 4, None)]
    assert R.trend(d).count() == 1


def test_rates_title_axis(spark):
    df = chain(series(spark, CASES["line"]))
    rates = R.trend_rates(df)
    r = rates.first()
    assert (r.per_year, r.per_century) == (0.12, 12.0)
    units = spark.createDataFrame([("s", LEVEL, "ft")], "station_id string, variable string, unit string")
    assert R.trend_title(rates, units).first().heading == (
        "Trend of water level, 1/31/1990 - 12/31/1993: 0.12 ft a year, 12.0 ft a century")
    small = rates.withColumns({"per_year": F.lit(0.0008), "per_century": F.lit(-0.08)})
    assert R.trend_title(small, units).first().heading.endswith(": 0.0008 ft a year, -0.08 ft a century")
    below = R.trend_axis(series(spark, [-1.0, -2.0, None])).first()
    assert (below.y_min, below.y_max) == (-2.5, 0.45)
    mixed = R.trend_axis(series(spark, [-1.0, 2.0])).first()
    assert (mixed.y_min, mixed.y_max) == (None, None)


# --- curves ---


def year_of(f, skip=()):
    start = dt.date(2020, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(366)]
    return [("s", AIR, d.isoformat(), f(i), f(i) - 2.0) for i, d in enumerate(days) if i not in skip]


def least_squares(x, y, freq):
    a = np.column_stack([np.cos(freq * x), np.sin(freq * x), np.ones_like(x)])
    coef, *_ = np.linalg.lstsq(a, y, rcond=None)
    return a @ coef, coef


@pytest.mark.parametrize("skip", [(), tuple(range(40, 70)), tuple(range(0, 366, 3))])
def test_harmonic_fit_is_least_squares(spark, skip):
    def f(i):
        return 20 + 8 * math.cos(2 * math.pi * i / 366 + 2.5) + 3 * math.sin(i / 9)

    rows = V.harmonic_fit(daily_stats(daily_frame(spark, year_of(f, skip)))).orderBy("yearday").collect()
    x = np.array([i / 366 for i in range(366) if i not in skip])
    fitted, coef = least_squares(x, np.array([f(i) for i in range(366) if i not in skip]), V.ANNUAL)
    got = [r.average_high_curve for i, r in enumerate(rows) if i not in skip]
    assert np.allclose(got, fitted, atol=1e-9)
    # Labels without data are on the curve too.
    full = coef[0] * np.cos(V.ANNUAL * np.arange(366) / 366) + coef[1] * np.sin(V.ANNUAL * np.arange(366) / 366) + coef[2]
    assert np.allclose([r.average_high_curve for r in rows], full, atol=1e-9)
    assert np.allclose([r.average_low_curve for r in rows], full - 2, atol=1e-9)


def test_harmonic_fit_needs_three_points(spark):
    stats = daily_stats(daily_frame(spark, [("s", AIR, "2020-01-01", 3.0, 1.0)]))
    assert {r.average_high_curve for r in V.harmonic_fit(stats).collect()} == {None}


def test_harmonic_search_against_brute_force(spark):
    def f(i):
        return 20 + 8 * math.cos(5.237 * i / 366 + 2.5)

    best = V.harmonic_search(daily_stats(daily_frame(spark, year_of(f))))
    r = best.where("curve = 'average_high'").first()
    x = np.arange(366) / 366
    y = np.array([f(i) for i in range(366)])
    errors = {}
    for k in range(1000, 12567):
        freq = k / 1000
        errors[freq] = np.mean((least_squares(x, y, freq)[0] - y) ** 2) if abs(freq - 5.237) < 0.5 else np.inf
    want = min(errors, key=errors.get)
    assert abs(r.frequency - want) < 2e-3 and r.error < 1e-6
    assert best.count() == 3
    fitted = V.harmonic_fit_free(daily_stats(daily_frame(spark, year_of(f)))).orderBy("yearday").collect()
    assert np.allclose([q.average_low_curve for q in fitted], y - 2, atol=1e-3)


@pytest.mark.parametrize("frequency", [15.3, 0.6])
def test_harmonic_search_goes_beyond_the_first_grid(spark, frequency):
    def f(i):
        return 20 + 8 * math.cos(frequency * i / 366 + 2.5)

    stats = daily_stats(daily_frame(spark, year_of(f)))
    best = V.harmonic_search(stats)
    r = best.where("curve = 'average_high'").first()
    assert abs(r.frequency - frequency) < 2e-3 and r.error < 1e-5
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    if frequency == 15.3:  # What goes on is only the grid whose best is its last one.
        assert V.harmonic_search(stats, high=6.0).where("curve = 'average_high'").first().frequency < 30


def test_monthly_curves(spark):
    rows = [("s", LEVEL, dt.date(2001, 1, 1) + dt.timedelta(days=i)) for i in range(365)]
    d = daily_frame(spark, [(s, v, day.isoformat(), 5 + math.cos(2 * math.pi * day.month / 12), 1.0) for s, v, day in rows])
    fitted = V.harmonic_fit(monthly_stats(d)).orderBy("month").collect()
    assert len(fitted) == 12
    assert all(abs(r.monthly_average_curve - r.monthly_average) < 1e-9 for r in fitted)
    assert R.trend(d).agg(F.count("*")).first()[0] == 12
