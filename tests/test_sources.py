import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import AIR, LEVEL, day_rows, obs
from tidemark import shared
from tidemark.dimensions import STATIONS
from tidemark.operators.combine import last_obs
from tidemark.operators.published import yesterday_summary
from tidemark.operators.quality import daily_summary, daily_table
from tidemark.schemas import PRODUCTS
from tidemark.snapshots import Snapshots
from tidemark.sources import metadata as M
from tidemark.sources import observations as O
from tidemark.sources import products as P
from tidemark.sources import stations as S
from tidemark.sources.statistics import stats_table


def test_reads_a_foreign_gzip_record(spark, tmp_path):
    folder = tmp_path / "station_id=0123"
    folder.mkdir()
    with gzip.open(folder / "record.csv.gz", "wt") as fp:
        fp.write("time_lst,Air Temperature,Water Level,Water Level QC\n")
        fp.write("2020-01-01 00:00:00,1.5,2.5,p\n")
        fp.write("2020-01-01 00:06:00,,,v\n")
        fp.write("2020-01-01 00:12:00,3.5,,\n")
    rows = O.read_record_csv(spark, str(tmp_path), [AIR, LEVEL]).orderBy("ts", "variable").collect()
    assert [(r.station_id, r.variable, r.ts.minute, r.value, r.qc) for r in rows] == [
        ("0123", AIR, 0, 1.5, None),
        ("0123", LEVEL, 0, 2.5, "p"),
        ("0123", LEVEL, 6, None, "v"),
        ("0123", AIR, 12, 3.5, None),
    ]


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "wind").mkdir()
    (tmp_path / "wind" / "f.csv").write_text(
        "wind_flag,windgust,windspeed,note,winddir,winddir_deg,ts,station_id\n"
        '"0,0,0",9.0,3.0,x,E,90.0,2020-01-01 00:06:00,s\n')
    rows = {r.variable: r.value for r in P.read_product(spark, str(tmp_path / "wind"), "wind").collect()}
    assert rows == {"Wind Speed": 3.0, "Wind Gust": 9.0}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f.csv").write_text(
        "time_lst,Air Temperature,Water Temperature\n2020-01-01 00:00:00,1.0,2.0\n")
    got = O.read_record_csv(spark, str(tmp_path / "one"), ["Water Temperature", AIR], station_id="007").collect()
    assert {(r.station_id, r.variable, r.value) for r in got} == {("007", AIR, 1.0), ("007", "Water Temperature", 2.0)}
    with pytest.raises(ValueError, match="station_id"):
        O.read_record_csv(spark, str(tmp_path / "one"), [AIR])
    with pytest.raises(ValueError, match="windspeed|atemp"):
        P.read_product(spark, str(tmp_path / "wind"), "air_temperature")


def test_observation_years_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "o")
    rows = [("007", AIR, "2019-01-01 00:00", 1.0), ("007", AIR, "2020-01-01 00:00", 2.0)]
    O.write_observations(obs(spark, rows), path)
    O.write_observations(obs(spark, [("007", AIR, "2020-05-01 00:00", 3.0)]), path)
    O.write_observations(obs(spark, [("008", AIR, "2020-05-01 00:00", 4.0)]), path, "append")
    got = sorted((r.station_id, r.ts.year, r.value) for r in O.read_observations(spark, path).collect())
    assert got == [("007", 2019, 1.0), ("007", 2020, 3.0), ("008", 2020, 4.0)]


def test_manifest_counts_rows_without_sorting_them(spark, tmp_path):
    path = str(tmp_path / "o")
    rows = [("007", v, f"{y}-01-01 {h:02d}:00", 1.0) for v in (AIR, LEVEL) for y in (2019, 2020) for h in range(5)]
    with Snapshots(spark, path).begin("test") as commit:
        commit.put(O.OBSERVATION_TABLE, obs(spark, rows))
        assert sorted(tuple(r)[:3] for r in commit.view.series(O.OBSERVATION_TABLE).collect()) == [("007", AIR, 10), ("007", LEVEL, 10)]
        for layout in (O.OBSERVATION_TABLE, stats_table("daily")):
            stored = spark.createDataFrame([], layout.schema).withColumn("part", F.lit("x"))
            files = str(tmp_path / layout.name)
            stored.write.parquet(files)
            plan = commit._entries(layout, spark.read.parquet(files))._jdf.queryExecution().executedPlan().toString()
            first = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
            assert "- HashAggregate(" in first, "rows of a task are sorted before they are counted"


def test_filters_prune_directories(spark, tmp_path):
    path = str(tmp_path / "o")
    O.write_observations(obs(spark, [("a", AIR, "2019-01-01 00:00", 1.0), ("b", AIR, "2020-01-01 00:00", 2.0)]), path)
    df = O.read_observations(spark, path).where("station_id = 'a'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and df.count() == 1


@pytest.mark.parametrize("product", sorted(PRODUCTS))
def test_product_layouts(spark, tmp_path, product):
    sample = {"double": 1.5, "string": "0,0,0"}
    fields = PRODUCTS[product].fields
    line = ["s", "2020-01-01 00:06:00"] + [str(sample[f.dataType.simpleString()]) for f in fields[2:]]
    quoted = [f'"{x}"' for x in line]
    (tmp_path / "f.csv").write_text(",".join(f.name for f in fields) + "\n" + ",".join(quoted) + "\n")
    rows = P.read_product(spark, str(tmp_path), product).collect()
    assert len(rows) == (2 if product == "wind" else 1)
    assert all(r.value == 1.5 and r.flag == "0,0,0" and r.station_id == "s" for r in rows)
    assert {r.qc for r in rows} == {{"hourly_height": "v", "water_level": "0,0,0"}.get(product)}


def test_flagged_readings(spark):
    rows = [("s", LEVEL, dt.datetime(2020, 1, 1, h), 1.0, "p", f) for h, f in ((0, "0,0"), (1, "0,1"))]
    df = spark.createDataFrame(rows, "station_id string, variable string, ts timestamp_ntz, value double, qc string, flag string")
    level = [tuple(r)[3:] for r in P.discard_flagged(df, "water_level").orderBy("ts").collect()]
    assert level == [(1.0, "p"), (None, "p")]
    hourly = [tuple(r)[3:] for r in P.discard_flagged(df, "hourly_height").orderBy("ts").collect()]
    assert hourly == [(1.0, "p"), (None, None)]
    with pytest.raises(ValueError, match="unknown product"):
        P.discard_flagged(df, "salinity")


def test_registry(spark, tmp_path):
    (tmp_path / "stations.json").write_text(json.dumps(STATIONS, indent=2))
    registry = S.read_stations(spark, str(tmp_path))
    assert registry.count() == 7
    asked = spark.createDataFrame([("Lewes, DE",), ("Nowhere, XX",)], "station_name string")
    got = {r.station_name: r for r in S.resolve_stations(asked, registry).collect()}
    assert got["Lewes, DE"].station_id == "8557380" and got["Lewes, DE"].dirname == "_lewesDe"
    assert not got["Nowhere, XX"].known and got["Nowhere, XX"].station_key == "nowhereXx"


def test_metadata_round_trip_and_replacement(spark, tmp_path):
    o = obs(spark, day_rows("007", AIR, "2020-01-01", range(24), 2.0) + day_rows("008", LEVEL, "2020-01-01", range(3)))
    config = spark.createDataFrame(
        [("Lewes, DE", "007", "metric", "lst", "MHHW"), ("Naples, FL", "008", "english", "gmt", "NAVD")],
        "stationname string, station_id string, unit_system string, tz string, datum string")
    day = yesterday_summary(daily_table(o), F.lit("2020-01-02"))
    built = M.build_metadata(config, last_obs(o), day, 4, 2)
    path = str(tmp_path / "m")
    M.write_metadata(built, path)
    got = {r.station_id: r for r in M.read_metadata(spark, path).collect()}
    assert got["007"].units == {AIR: "°C"} and got["007"].yesterday.high == {AIR: 2.0}
    assert got["007"].last_obs == {AIR: dt.datetime(2020, 1, 1, 23)}
    assert got["008"].variables == [LEVEL] and got["008"].yesterday is None
    M.write_metadata(M.build_metadata(config.where("station_id = '008'"), last_obs(o), day, 1, 1), path)
    got = {r.station_id: r.hr_threshold for r in M.read_metadata(spark, path).collect()}
    assert got == {"007": 4, "008": 1}


def test_shared_dir_follows_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://x/scratch/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared.shared_dir(Session()) == "hdfs://x/scratch"

    class NoDir:
        class conf:
            get = staticmethod({"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}.get)

    assert shared.shared_dir(NoDir()) == "hdfs://x/warehouse/_work"


def test_daily_round_trip(spark, tmp_path):
    daily = daily_summary(obs(spark, day_rows("007", LEVEL, "2020-01-01", range(5), 2.0, "p")))
    path = str(tmp_path / "d")
    O.write_daily(daily, path)
    assert [tuple(r) for r in O.read_daily(spark, path).collect()] == [tuple(r) for r in daily.collect()]
    assert O.read_daily(spark, path).first().preliminary
