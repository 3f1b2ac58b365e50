"""Daily sums kept up with landed batches against the operators over all readings."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions.values import conform
from stationlake.operators import completeness, exposure, violations
from stationlake.sources import readings, snapshots
from stationlake.streaming import daily, ingest
from tests.conftest import rows
from tests.test_sources import write_long

T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(4)
    data = [
        (r.choice(["1", "2", "3", None]), r.choice(["A", "B"]), r.choice(["pm25", "no2"]),
         T0 + timedelta(minutes=r.randrange(0, 70 * 1440, 7)), r.choice([None, float("nan"), 5.0, 36.0, 50.25, 35.0]))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(data, "station_id string, location_name string, parameter string, ts timestamp, value double")
    return conform(df, schemas.READINGS).cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    got, want = (sorted(map(str, rows(x.select(*sorted(a.columns)).withColumns(
        {c: F.round(c, 9) for c, k in a.dtypes if k == "double"})))) for x in (a, b))
    assert got == want and got


def check(spark, path, events):
    held = daily.read_daily(spark, path)
    month = [F.month("day").alias("month")], [F.month("ts").alias("month")]
    for safe in (False, True):
        same(daily.violation_rates(held, ["station_id", "parameter", *month[0]], safe),
             violations.violation_rate(events, ["station_id", "parameter", *month[1]], null_as_safe=safe))
    same(daily.means(held), exposure.station_means(events))
    same(daily.covered(held, "2025-01-05", "2025-03-01 00:00:00", ["station_id", "parameter"]),
         completeness.coverage(events, "2025-01-05", "2025-03-01", ["station_id", "parameter"]))


@pytest.mark.parametrize("fan", [0, 2, 4])
def test_state_after_batches_equals_the_whole(spark, tmp_path, events, fan):
    path = str(tmp_path / "d")
    parts = events.randomSplit([1.0] * 6, seed=1)
    for k, part in enumerate(parts):
        assert daily.land_daily(part, path, "s", k, fan)
    assert not daily.land_daily(parts[3], path, "s", 3, fan)
    check(spark, path, events)
    if fan:
        assert all(len(snapshots.snapshot(spark, path).of([p])) <= 3 * (fan - 1) for p in ("pm25", "no2"))
    pruned = daily.read_daily(spark, path, ["pm25"])
    assert [r[0] for r in pruned.select("parameter").distinct().collect()] == ["pm25"]


def test_a_replaced_series_is_replaced(spark, tmp_path, events):
    path, table = str(tmp_path / "d"), str(tmp_path / "t")
    daily.land_daily(events, path, "s", 0)
    readings.write_readings(events, table)
    again = events.where("station_id = '2' and parameter = 'no2'").withColumn("value", F.lit(99.0))
    daily.replace_daily(again, path)
    readings.write_readings(again, table)
    check(spark, path, readings.read_readings(spark, table))


def test_empty_state_and_borders_within_a_day(spark, tmp_path):
    held = daily.read_daily(spark, str(tmp_path / "none"))
    assert held.count() == 0 and daily.means(held).count() == 0
    assert daily.covered(held, "2025-01-01", "2025-02-01").count() == 0
    with pytest.raises(ValueError, match="whole days"):
        daily.covered(held, "2025-01-01 05:00:00", "2025-02-01")


def test_landing_keeps_the_state_up(spark, tmp_path):
    raw, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    args = (spark, str(raw / "*"), out, str(tmp_path / "cp"))
    write_long(raw, "A_1", "a.csv", ["2025-01-01 00:00:00,PM2.5,10,u,A,1", "2025-01-01 05:00:00,PM2.5,50,u,A,1"])
    ingest.land_long(*args, daily_out=state)
    write_long(raw, "A_1", "b.csv", ["2025-01-01 05:30:00,pm25,40,u,A,1", "2025-01-02 00:00:00,no2,,u,A,1"])
    ingest.land_long(*args, daily_out=state)
    got = rows(daily.read_daily(spark, state).drop("day"), "parameter")
    assert got == [("1", "A", "no2", 1, 0, 0.0, 0, 1), ("1", "A", "pm25", 3, 3, 100.0, 2, 1 | 1 << 5)]


def test_station_sketches_stay_within_their_error(spark, tmp_path):
    path = str(tmp_path / "s")
    ids = spark.range(0, 60000).selectExpr(
        "cast(id % 20011 as string) AS station_id", "'A' AS location_name", "if(id % 2 = 0, 'pm25', 'no2') AS parameter",
        "timestamp'2025-01-01' + make_interval(0, 0, 0, cast(id % 40 as int)) AS ts",
        "if(id % 10 = 9, cast(null as double), 1.0) AS value")
    df = conform(ids, schemas.READINGS)
    for k in range(5):
        assert daily.land_sketches(df.where(F.expr(f"cast(station_id as int) % 5 = {k}")), path, "s", k, fan=2)
    assert not daily.land_sketches(df, path, "s", 4)
    valid = df.where("value is not null")
    for keys, exact_keys in ((["parameter"], ["parameter"]), (["parameter", F.month("day").alias("m")], ["parameter", F.month("ts").alias("m")])):
        got = {tuple(r)[:-2]: tuple(r)[-2:] for r in daily.distinct_stations(spark, path, keys).collect()}
        want = {tuple(r)[:-2]: tuple(r)[-2:] for r in valid.groupBy(*exact_keys).agg(
            F.count("*").alias("n"), F.count_distinct("station_id").alias("s")).collect()}
        assert got.keys() == want.keys()
        for key, (n, stations) in want.items():
            assert got[key][0] == n and abs(got[key][1] - stations) <= 0.015 * stations
    assert all(len(snapshots.snapshot(spark, path).of([p])) <= 3 for p in ("pm25", "no2"))
    assert daily.distinct_stations(spark, str(tmp_path / "none")).count() == 0
