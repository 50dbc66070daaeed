import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark import functions as f
from tidemark.dimensions import flood_thresholds


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_flag_sum(spark):
    assert values(spark, f.flag_sum("x"), ["0,0,0", "0,1,0", "1,2,3", "4", None]) == [0, 1, 6, 4, None]


def test_mask_flagged(spark):
    rows = [(1.5, "0,0,0"), (1.5, "0,1,0"), (1.5, None)]
    got = values(spark, f.mask_flagged("v", "x"), rows, "v double, x string")
    assert got == [1.5, None, 1.5]


def test_mask_flagged_row_keeps_only_keys(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "0,0", "v"), ("b", 2.0, "0,1", "v")], "k string, v double, flag string, qc string"
    )
    got = [tuple(r) for r in f.mask_flagged_row(df, "flag", ["k"]).orderBy("k").collect()]
    assert got == [("a", 1.0, "0,0", "v"), ("b", None, None, None)]


def test_fill_and_nan(spark):
    nan = float("nan")
    got = values(spark, f.null_fill_value(f.nan_to_null("x")), [31.8, 31.9, nan, 0.0], "x double")
    assert got == [None, 31.9, None, 0.0]


def test_fill_for_some_variables(spark):
    rows = [(31.8, "Air Temperature"), (31.8, "Water Level")]
    c = f.null_fill_value("v", variable="x", variables=["Air Temperature"])
    assert values(spark, c, rows, "v double, x string") == [None, 31.8]


@pytest.mark.parametrize(
    "day, expected",
    [
        ("1999-01-01", 1),
        ("1999-02-28", 59),
        ("1999-03-01", 61),
        ("1999-12-31", 366),
        ("1996-02-29", 60),
        ("1996-03-01", 61),
        ("1996-12-31", 366),
        ("2000-02-29", 60),
        ("2001-03-01", 61),
        ("1900-03-01", 61),
        ("1900-12-31", 366),
    ],
)
def test_yearday366(spark, day, expected):
    assert values(spark, f.yearday366(F.to_date("x")), [day]) == [expected]


def test_format_date_and_range(spark):
    assert values(spark, f.format_date("x"), ["2024-02-09", "2024-02-09 13:00:00"]) == ["20240209"] * 2
    c = f.format_range(F.to_date("x"), F.lit(dt.date(2024, 11, 30)))
    assert values(spark, c, ["2024-02-09"]) == ["2/9/2024 - 11/30/2024"]


def test_month_numbers_round_trip(spark):
    got = values(spark, f.month_from_number(f.month_number(F.to_date("x"))), ["1999-12-31", "2000-01-01"])
    assert got == [dt.date(1999, 12, 1), dt.date(2000, 1, 1)]


@pytest.mark.parametrize(
    "x, down, up",
    [(45.5, 40.0, 50.0), (50.0, 50.0, 60.0), (-45.5, -50.0, -40.0), (-50.0, -50.0, -40.0), (0.0, 0.0, 10.0)],
)
def test_round_down_up(spark, x, down, up):
    assert values(spark, f.round_down("x", 10), [x], "x double") == [down]
    assert values(spark, f.round_up("x", 10), [x], "x double") == [up]


def test_round_stat_halves_go_to_even(spark):
    rows = [(26.25, "Air Temperature"), (26.35, "Air Temperature"), (1.125, "Water Level")]
    assert values(spark, f.round_stat("x", "v"), rows, "v double, x string") == [26.2, 26.4, 1.12]


@pytest.mark.parametrize(
    "name, key",
    [
        ("Bay St. Louis, MS", "bayStLouisMs"),
        ("Virginia Key, FL", "virginiaKeyFl"),
        ("naples", "naples"),
        ("A-b_c  d", "aBCD"),
        ("", ""),
    ],
)
def test_station_key(spark, name, key):
    assert values(spark, f.station_key("x"), [name]) == [key]


def test_station_dirname(spark):
    assert values(spark, f.station_dirname("x"), ["Lewes, DE"]) == ["_lewesDe"]


def test_unit_for(spark):
    rows = [("Water Level", "English"), ("Wind Gust", "metric"), ("Salinity", "metric")]
    assert values(spark, f.unit_for("a", "b"), rows, "a string, b string") == ["ft", "m/s", None]


def config(spark, unit="Metric", tz="LST", datum="mhhw"):
    return spark.createDataFrame([(unit, tz, datum)], "unit_system string, tz string, datum string")


def test_validate_config(spark):
    assert f.validate_config(config(spark)).first().valid
    bad = f.validate_config(config(spark, unit="imperial", datum=None)).first()
    assert not bad.valid_units and bad.valid_tz and not bad.valid_datum and not bad.valid


def test_validate_config_stops_the_job(spark):
    good = f.validate_config(config(spark), fail=True).first()
    assert (good.unit_system, good.tz, good.datum) == ("metric", "lst", "MHHW")
    with pytest.raises(Exception, match="timezone=utc"):
        f.validate_config(config(spark, tz="utc"), fail=True).collect()


def test_flood_thresholds(spark):
    rows = flood_thresholds(spark)
    assert rows.count() == 21
    assert not any(math.isnan(r.value) for r in rows.collect())
