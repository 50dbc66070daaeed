import csv
import datetime as dt
import pathlib
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import AIR, LEVEL, day_rows, obs
from tidemark.operators.daily import all_months
from tidemark.operators.normals import daily_stats, data_range, monthly_stats
from tidemark.operators.quality import daily_summary, daily_table
from tidemark.operators.trend import trend, trend_rates
from tidemark.plans import jobs
from tidemark.plans.store import Store
from tidemark.schemas import MONTHS
from tidemark.snapshots import Commit, Conflict
from tidemark.sources.observations import DAILY_TABLE, OBSERVATION_TABLE
from tidemark.sources.products import normalise_product
from tidemark.streaming.refresh import follow_records, refresh_on_landing

AS_OF = dt.date(2020, 1, 6)
FIELDS = "stationname string, station_id string, unit_system string, tz string, datum string"


def config(spark, *ids):
    return spark.createDataFrame([(f"Town {i}, XX", i, "English", "LST", "mhhw") for i in ids], FIELDS)


def history(station, days=range(1, 7), year=2020):
    rows = []
    for d in days:
        qc = "v" if d < 4 else "p"
        rows += day_rows(station, LEVEL, f"{year}-01-{d:02d}", range(24), float(d), qc)
        rows += day_rows(station, AIR, f"{year}-01-{d:02d}", range(24), 50.0 + d)
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_one_shot(store, o):
    assert rows_of(store.observations()) == rows_of(o)
    assert rows_of(store.daily()) == rows_of(daily_summary(o))
    daily = daily_table(o)
    assert rows_of(store.stats("daily")) == rows_of(daily_stats(daily))
    assert rows_of(store.stats("monthly")) == rows_of(monthly_stats(daily))


def test_load_then_refresh_equals_one_load(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    o = obs(spark, history("1") + history("2") + history("1", range(30, 32), 2019))
    early = o.where(F.col("ts") < dt.datetime(2020, 1, 3, 12))
    jobs.initial_load(store, early, config(spark, "1", "2"), AS_OF)
    same_as_one_shot(store, early)
    assert jobs.update_data(store, o.where(F.col("ts") >= dt.datetime(2020, 1, 3)), AS_OF)
    report = jobs.update_stats(store)
    same_as_one_shot(store, o)
    meta = {r.station_id: r for r in store.metadata().collect()}
    assert meta["1"].last_obs == {AIR: dt.datetime(2020, 1, 6, 23), LEVEL: dt.datetime(2020, 1, 6, 23)}
    assert meta["1"].yesterday.high == {AIR: 55.0, LEVEL: 5.0}
    assert (meta["1"].unit_system, meta["1"].datum, meta["1"].units[LEVEL]) == ("english", "MHHW", "ft")
    first = report["daily"].where("date_label = '05-Jan' and record = 'record_high' and station_id = '1'")
    assert first.count() == 2
    # Once more brings nothing.
    assert not jobs.update_data(store, o, AS_OF)
    assert all(r.isEmpty() for r in jobs.update_stats(store).values())
    same_as_one_shot(store, o)


def test_in_pieces_equals_at_once(spark, tmp_path):
    o = obs(spark, history("1"))
    store = Store(spark, str(tmp_path / "store"))
    jobs.initial_load(store, o.where(F.dayofmonth("ts") == 1), config(spark, "1"), AS_OF)
    for d in (2, 4, 6):
        jobs.update_data(store, o.where(F.dayofmonth("ts") <= d), AS_OF)
    jobs.update_stats(store)
    same_as_one_shot(store, o)


def test_verified_levels_replace_preliminary_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    jobs.initial_load(store, obs(spark, history("1")), config(spark, "1"), AS_OF)
    verified = [
        ("1", LEVEL, "2020-01-02 00:00", 99.0, "v"),  # verified already
        ("1", LEVEL, "2020-01-04 00:00", 40.0, "v"),
        ("1", LEVEL, "2020-01-04 01:00", None, "v"),
        ("1", AIR, "2020-01-04 00:00", 99.0, None),  # only levels are read again
    ]
    assert not jobs.update_data(store, obs(spark, verified), AS_OF)
    level = {r.ts: (r.value, r.qc) for r in store.observations().where(F.col("variable") == LEVEL).collect()}
    assert level[dt.datetime(2020, 1, 2)] == (2.0, "v")
    assert level[dt.datetime(2020, 1, 4)] == (40.0, "v")
    assert level[dt.datetime(2020, 1, 4, 1)] == (4.0, "v")
    assert level[dt.datetime(2020, 1, 4, 2)] == (4.0, "p")
    assert store.observations().where(F.col("value") == 99.0).isEmpty()
    report = jobs.update_stats(store)["daily"].where("record = 'record_high'").collect()
    assert [(r.date_label, r.value, r.old_value, r.year) for r in report] == [("04-Jan", 40.0, 4.0, 2020)]
    assert "was 4.0 ft (2020)" in report[0].message


def test_batches_of_unknown_stations_are_left_out(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    jobs.initial_load(store, obs(spark, history("1", [1])), config(spark, "1"), AS_OF)
    assert not jobs.update_data(store, obs(spark, history("9", [2])), AS_OF)
    assert store.observations().where("station_id = '9'").isEmpty()


def test_reload_needs_consent_and_drops_old_years(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    both = obs(spark, history("1 a") + history("1 a", year=2018) + history("2", year=2018))
    jobs.initial_load(store, both, config(spark, "1 a", "2"), AS_OF)
    again = obs(spark, history("1 a"))
    with pytest.raises(ValueError, match="redownload"):
        jobs.initial_load(store, again, config(spark, "1 a"), AS_OF)
    jobs.initial_load(store, again, config(spark, "1 a"), AS_OF, redownload=True)
    years = {(r.station_id, r.ts.year) for r in store.observations().collect()}
    assert years == {("1 a", 2020), ("2", 2018)}
    assert {(r.station_id, r.date.year) for r in store.daily().collect()} == years


def test_a_bad_configuration_writes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    bad = config(spark, "1").withColumn("tz", F.lit("mars"))
    with pytest.raises(Exception, match="timezone"):
        jobs.initial_load(store, obs(spark, history("1")), bad, AS_OF)
    assert not store.exists("observations")


def test_reprocess_one_station(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    o = obs(spark, [r for s in "12" for r in day_rows(s, AIR, "2020-01-01", range(21))])
    jobs.initial_load(store, o, config(spark, "1", "2"), AS_OF)
    assert store.stats("daily").where("record_high is not null").count() == 2
    jobs.reprocess(store, 1, 2, stations=["1"])
    assert {r.station_id: r.hr_threshold for r in store.metadata().collect()} == {"1": 1, "2": 4}
    with_data = store.stats("daily").where("record_high is not null")
    assert [r.station_id for r in with_data.collect()] == ["2"]


def landed_levels(spark, days):
    rows = [(s, t, v, 0.1, "0,0,0", q) for s, _, t, v, q in map(tuple, obs(spark, [
        r for r in history("1", days) if r[1] == LEVEL]).collect())]
    return spark.createDataFrame(
        rows, "station_id string, ts timestamp_ntz, wlevel double, s double, wlevel_flag string, wlevel_qc string")


def test_combine_products(spark):
    levels = landed_levels(spark, [2, 3])
    hourly = landed_levels(spark, [1, 2]).drop("wlevel_qc")
    record = jobs.combine_products({
        "water_level": normalise_product(levels, "water_level"),
        "hourly_height": normalise_product(hourly, "hourly_height"),
    })
    assert record.count() == 3 * 24
    with pytest.raises(ValueError, match="water levels"):
        jobs.combine_products({"hourly_height": normalise_product(hourly, "hourly_height")})


def test_refresh_on_landing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    level = obs(spark, [r for r in history("1") if r[1] == LEVEL])
    jobs.initial_load(store, level.where(F.dayofmonth("ts") <= 2), config(spark, "1"), AS_OF)
    landing, check = str(tmp_path / "landing"), str(tmp_path / "check")
    for days in ([2, 3], [4, 5, 6]):
        landed_levels(spark, days).write.mode("append").option("header", True).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(landing)
        refresh_on_landing(store, {"water_level": landing}, check, AS_OF).awaitTermination()
    same_as_one_shot(store, level)
    with pytest.raises(ValueError, match="first load"):
        refresh_on_landing(store, {"hourly_height": landing}, check, AS_OF)


def test_landing_files_with_headers_of_their_own(spark, tmp_path):
    """Other orders, more columns, quoted names, odd file names, compressed and empty files."""
    store = Store(spark, str(tmp_path / "store"))
    level = obs(spark, [r for r in history("1") if r[1] == LEVEL])
    jobs.initial_load(store, level.where(F.dayofmonth("ts") <= 2), config(spark, "1"), AS_OF)
    landing = tmp_path / "land ing"
    landing.mkdir()
    columns = landed_levels(spark, [2]).columns
    orders = [columns, columns[::-1], [*columns[2:], "note", *columns[:2]], ["note", *columns[::-1]]]
    for day, order in zip((3, 4, 5, 6), orders, strict=True):
        rows = landed_levels(spark, [day]).withColumn("note", F.lit("a, b"))
        rows = rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        table = rows.select(*order).toPandas()
        name = {4: "day [4]%20.csv", 5: "day 5.csv.gz"}.get(day, f"day{day}.csv")
        table.to_csv(landing / name, index=False, quoting=csv.QUOTE_ALL if day == 6 else csv.QUOTE_MINIMAL)
    (landing / "empty.csv").write_text("")
    refresh_on_landing(store, {"water_level": str(landing)}, str(tmp_path / "check"), AS_OF).awaitTermination()
    same_as_one_shot(store, level)
    # A file without one of the columns stops the stream, and nothing of it counts.
    version = store.snapshots.latest()
    (landing / "bad.csv").write_text("ts,station_id\n2020-01-07 00:00:00,1\n")
    with pytest.raises(StreamingQueryException, match="no header"):
        refresh_on_landing(store, {"water_level": str(landing)}, str(tmp_path / "check"), AS_OF).awaitTermination()
    assert store.snapshots.latest() == version


def spoil(store, layout, condition):
    """Make the files of some parts unreadable, so that reading them is an error."""
    parts = store.view.parts(layout).where(condition).collect()
    assert parts
    for r in parts:
        folder = pathlib.Path(store.root) / layout.name / f"folder={r.folder}" / f"part={r.part}"
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"spoilt")


def test_refresh_opens_touched_directories_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    # Of the other station, too, only yesterday's year is looked at.
    o = obs(spark, history("1", [1, 2], 2018) + history("1", [1]) + history("2", [1], 2019))
    jobs.initial_load(store, o, config(spark, "1", "2"), AS_OF)
    spoil(store, OBSERVATION_TABLE, "station_id = '2' OR year = 2018")
    spoil(store, DAILY_TABLE, "station_id = '2'")
    pairs = [("1", 2020), *((f"s{i}", 2020 - i % 50) for i in range(10_000))]
    touched = spark.createDataFrame(pairs, "station_id string, year int")
    part = store.observations(touched)
    assert {(r.station_id, r.ts.year) for r in part.collect()} == {("1", 2020)}
    assert store.observations(touched.where("year = 1")).isEmpty()
    # A whole refresh of station 1 looks at nothing else either.
    jobs.update_data(store, obs(spark, history("1", [2])), AS_OF)
    jobs.update_stats(store)
    days = store.daily(touched).where("variable = 'Water Level'")
    assert days.count() == 2
    assert store.stats("daily").where("station_id = '1' AND record_high = 2.0").count() > 0


def refreshed_and_verified(spark):
    o = obs(spark, history("1"))
    early = o.where(F.col("ts") < dt.datetime(2020, 1, 5))
    verified = o.where(F.dayofmonth("ts") >= 4).withColumn("qc", F.when(F.col("variable") == LEVEL, "v"))
    return early, verified, o.where(F.dayofmonth("ts") < 4).unionByName(verified)


def dies_at(monkeypatch, cls, step, nth):
    real, calls = getattr(cls, step), []

    def dies(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == nth:
            raise RuntimeError("lost")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(cls, step, dies)


@pytest.mark.parametrize("step, nth", [("_write", 1), ("_enter", 2), ("publish", 1), ("_enter", 8)])
def test_a_death_leaves_the_old_version_whole(spark, tmp_path, monkeypatch, step, nth):
    """Before a write, after the files of one (half an append), and before the pointer."""
    store = Store(spark, str(tmp_path / "store"))
    early, verified, want = refreshed_and_verified(spark)
    jobs.initial_load(store, early, config(spark, "1"), AS_OF)
    before = {1: rows_of(store.observations())}
    dies_at(monkeypatch, Commit, step, nth)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.update_data(store, verified, AS_OF)
        before[2] = rows_of(store.observations())
        jobs.update_stats(store)
    monkeypatch.undo()
    assert rows_of(store.observations()) == before[store.snapshots.latest()]
    if store.snapshots.latest() == 1:
        same_as_one_shot(store, early)
    jobs.update_data(store, verified, AS_OF)
    jobs.update_stats(store)
    store.vacuum()
    same_as_one_shot(store, want)
    assert store.metadata().first().last_obs[AIR] == dt.datetime(2020, 1, 6, 23)
    live = {f for folders in store.view.folders.values() for f in folders}
    assert {p.name.removeprefix("folder=") for p in (tmp_path / "store").glob("[!_]*/folder=*")} == live


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    early, verified, want = refreshed_and_verified(spark)
    jobs.initial_load(store, early, config(spark, "1"), AS_OF)
    dies_at(monkeypatch, Commit, "_enter", 2)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.update_data(store, verified, AS_OF, source="s", batch_id=7)
    monkeypatch.undo()
    assert jobs.update_data(store, verified, AS_OF, source="s", batch_id=7)
    assert store.snapshots.latest() == 2
    other = verified.withColumn("value", F.lit(500.0))
    assert not jobs.update_data(store, other, AS_OF, source="s", batch_id=7)
    assert not jobs.update_data(store, other, AS_OF, source="s", batch_id=3)
    assert store.snapshots.latest() == 2
    jobs.update_stats(store)
    same_as_one_shot(store, want)
    ledger = {r.version: r for r in store.ledger().collect()}
    assert [ledger[v].job for v in sorted(ledger)] == ["initial_load", "update_data", "update_stats"]
    assert (ledger[2].source, ledger[2].batch, ledger[3].sources) == ("s", 7, {"s": 7})
    assert len(ledger[2].added["observations"]) == 2 and "observations" not in ledger[3].added


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    jobs.initial_load(store, obs(spark, history("1", [1])), config(spark, "1"), AS_OF)
    first, second = store.begin("a"), store.begin("b")
    for commit, value in ((first, 1.0), (second, 2.0)):
        commit.put(OBSERVATION_TABLE, obs(spark, [("1", AIR, "2021-01-01 00:00", value)]), "append")
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    assert [r.value for r in store.observations().where("year(ts) = 2021").collect()] == [1.0]


def test_verified_cells_are_deltas(spark, tmp_path):
    """Ten cells write no base file; compaction changes files, not rows."""
    store = Store(spark, str(tmp_path / "store"))
    o = obs(spark, history("1") + history("1", [5], 2018))
    jobs.initial_load(store, o, config(spark, "1"), AS_OF)
    base = {r.part for r in store.view.parts(OBSERVATION_TABLE).collect()}
    cells = obs(spark, [("1", LEVEL, f"2020-01-05 {h:02d}:00", None if h < 3 else 60.0 + h, "v") for h in range(10)])
    assert not jobs.update_data(store, cells, AS_OF)
    parts = store.view.parts(OBSERVATION_TABLE).collect()
    assert {r.part for r in parts if not r.delta} == base
    assert [(r.station_id, r.year, r.n_rows) for r in parts if r.delta] == [("1", 2020, 10)]
    again = cells.withColumn("value", F.col("value") + 1)
    late = obs(spark, [("1", LEVEL, "2020-01-06 05:00", 7.5, "v")])
    jobs.update_data(store, again.unionByName(late), AS_OF)
    hour, day = F.hour("ts"), F.to_date("ts")
    level = F.col("variable") == LEVEL
    fifth = level & (day == dt.date(2020, 1, 5)) & (hour < 10)
    want = o.withColumns({
        "value": F.when(fifth & (hour >= 3), 61.0 + hour).when(level & (F.col("ts") == dt.datetime(2020, 1, 6, 5)), 7.5).otherwise(F.col("value")),
        "qc": F.when(fifth | (level & (F.col("ts") == dt.datetime(2020, 1, 6, 5))), "v").otherwise(F.col("qc")),
    })
    jobs.update_stats(store)
    same_as_one_shot(store, want)
    jobs.compact(store)
    assert not any(r.delta for r in store.view.parts(OBSERVATION_TABLE).collect())
    same_as_one_shot(store, want)
    assert rows_of(store.at(1).observations()) == rows_of(o)
    store.vacuum()
    same_as_one_shot(store, want)
    assert rows_of(store.variables()) == [("1", AIR), ("1", LEVEL)]


def test_statistics_follow_random_refreshes(spark, tmp_path):
    """Values that come, change and go back, a late series, months that turn good."""
    rng = random.Random(5)
    store = Store(spark, str(tmp_path / "store"))

    def readings(station, variable, year, month, days, qc=None):
        rows = []
        for d in days:
            top = rng.randrange(100) / 2  # Sums of these are exact in any order.
            rows += [(station, variable, f"{year}-{month:02d}-{d:02d} {h:02d}:00", top + h % 7, qc) for h in range(rng.choice((21, 24, 12)) if qc is None else 24)]
        return rows

    every = [r for s in "12" for y in (2018, 2019) for r in readings(s, LEVEL, y, 2, range(1, 29), "p")]
    every += [r for y in (2018, 2019) for r in readings("1", AIR, y, 2, range(1, 20))]
    jobs.initial_load(store, obs(spark, every), config(spark, "1", "2"), AS_OF)
    table = {(r[0], r[1], dt.datetime.fromisoformat(r[2])): (r[3], r[4]) for r in every}
    for n in range(4):
        batch = readings("1", AIR, 2018 + n % 3, 2, rng.sample(range(20, 29), 3)) if n != 1 else readings("2", "Wind Speed", 2019, 3, range(1, 31))
        known = [k for k, (_, qc) in table.items() if k[1] == LEVEL and qc == "p" and k[0] == "21"[n % 2]]
        for k in rng.sample(known, 30):
            batch.append((k[0], k[1], k[2].isoformat(" "), rng.choice([None, 80.0, -80.0, table[k][0]]), rng.choice("pv")))
        jobs.update_data(store, obs(spark, batch), AS_OF)
        for s, v, t, value, qc in batch:
            k = (s, v, dt.datetime.fromisoformat(t))
            if k not in table:
                table[k] = (value, qc)
            elif v == LEVEL:
                old = table[k]
                table[k] = (old[0] if value is None else value, qc or old[1])
        o = spark.createDataFrame([(*k, *x) for k, x in table.items()], store.observations().schema)
        report = jobs.update_stats(store)
        same_as_one_shot(store, o)
        gated = daily_table(o)
        assert rows_of(store.months()) == rows_of(all_months(gated).select(*MONTHS.fieldNames()))
        for kind in ("daily", "monthly"):
            got = store.ranges().where(F.col("kind") == kind).drop("kind", "unit")
            assert rows_of(got) == rows_of(data_range(gated, kind))
        rates = trend_rates(trend(gated))
        assert rows_of(store.trends().drop("heading")) == rows_of(rates)
        assert store.pending().isEmpty()
        assert {r.station_id for r in report["daily"].collect()} <= {"1", "2"}
    assert {r.unit for r in store.ranges().where(F.col("variable") == LEVEL).collect()} == {"ft"}
    assert all(r.heading.startswith("Trend of water level") for r in store.trends().collect())


def test_new_records_are_kept(spark, tmp_path, monkeypatch):
    """Two refreshes with a death in between: each record once, in the log and in its stream."""
    store = Store(spark, str(tmp_path / "store"))
    jobs.initial_load(store, obs(spark, history("1", [1, 2])), config(spark, "1"), AS_OF)
    assert store.record_log().isEmpty()
    seen = []

    def take(rows, number):
        seen.extend((r.version, r.kind, r.label, r.variable, r.record) for r in rows.collect())

    check = str(tmp_path / "check")
    jobs.update_data(store, obs(spark, history("1", [3])), AS_OF)
    dies_at(monkeypatch, Commit, "publish", 1)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.update_stats(store)
    monkeypatch.undo()
    assert store.record_log().isEmpty()
    follow_records(store, take, check).awaitTermination()
    assert not seen
    first = jobs.update_stats(store)["daily"]
    assert {(r.date_label, r.record) for r in first.collect()} >= {("03-Jan", "record_high")}
    follow_records(store, take, check).awaitTermination()
    once = len(seen)
    assert once == store.record_log().count() == first.count() > 0
    jobs.update_data(store, obs(spark, history("1", [4])), AS_OF)
    second = jobs.update_stats(store)["daily"]
    follow_records(store, take, check).awaitTermination()
    log = [(r.version, r.kind, r.label, r.variable, r.record) for r in store.record_log().collect()]
    assert sorted(seen) == sorted(log) and len(set(log)) == len(log) == once + second.count()
    assert jobs.update_stats(store)["daily"].isEmpty() and store.record_log().count() == len(log)


def test_average_is_a_setting(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [r for d in (1, 2, 3) for r in day_rows("1", AIR, f"2020-01-{d:02d}", range(23), 1.0)]
    rows += [("1", AIR, f"2020-01-0{d} 23:00", 24.0, None) for d in (1, 2, 3)]
    o = obs(spark, rows)
    jobs.initial_load(store, o.where(F.dayofmonth("ts") < 3), config(spark, "1"), AS_OF, average="mean")
    jobs.update_data(store, o, dt.date(2020, 1, 4))
    report = jobs.update_stats(store)
    assert {r.date_label for r in report["daily"].collect()} == {"03-Jan"}
    want = daily_stats(daily_table(o), "mean")
    assert rows_of(store.stats("daily")) == rows_of(want)
    meta = store.metadata().first()
    assert meta.average == "mean" and meta.yesterday.average[AIR] == pytest.approx(47 / 24)
    jobs.update_stats(store, average="midrange")
    assert rows_of(store.stats("daily")) == rows_of(daily_stats(daily_table(o)))
    assert store.metadata().first().average == "midrange"
    with pytest.raises(ValueError, match="average"):
        jobs.update_stats(store, average="median")


def test_replayed_stream_batch(spark, tmp_path):
    """The stream forgets that it finished a batch; the ledger doesn't."""
    store = Store(spark, str(tmp_path / "store"))
    level = obs(spark, [r for r in history("1") if r[1] == LEVEL])
    jobs.initial_load(store, level.where(F.dayofmonth("ts") <= 2), config(spark, "1"), AS_OF)
    landing, check = str(tmp_path / "landing"), tmp_path / "check"
    landed_levels(spark, [3, 4]).write.mode("append").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(landing)
    refresh_on_landing(store, {"water_level": landing}, str(check), AS_OF).awaitTermination()
    version, log = store.snapshots.latest(), store.record_log().count()
    assert log > 0
    for file in (check / "commits").glob("*"):
        file.unlink()
    refresh_on_landing(store, {"water_level": landing}, str(check), AS_OF).awaitTermination()
    assert (store.snapshots.latest(), store.record_log().count()) == (version, log)
    same_as_one_shot(store, level.where(F.dayofmonth("ts") <= 4))
