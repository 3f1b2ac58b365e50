"""Bucketed readings: the same rows, and no shuffle before the aggregate."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from stationlake import schemas
from stationlake.functions.values import conform
from stationlake.operators.wide import station_pivot
from stationlake.sources import colocated
from stationlake.streaming import daily
from tests.conftest import rows

T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """Readings as they come and bucketed; one station holds half of them."""
    data = [("hot" if k % 2 else f"s{k % 30}", "A", ("pm25", "no2", "o3")[k % 3], T0 + timedelta(hours=k // 6), float(k)) for k in range(3000)]
    data += [(None, "A", "pm25", T0, 1.0), ("s1", None, "pm25", None, 2.0), ("s1", "A", "pm25", T0, None)]
    df = spark.createDataFrame(data, "station_id string, location_name string, parameter string, ts timestamp, value double")
    df = conform(df, schemas.READINGS)
    path = str(tmp_path_factory.mktemp("buckets") / "t")
    colocated.write_colocated(df, "colocated_probe", 8, path)
    yield df, colocated.read_colocated(spark, "colocated_probe"), path
    spark.sql("DROP TABLE colocated_probe")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_rows_without_a_shuffle(both):
    plain, held, _ = both
    wanted = ["pm25", "no2"]
    got = colocated.features(held, wanted)
    assert "Exchange" not in plan_of(got) and "Exchange" in plan_of(station_pivot(plain, ["station_id", "ts"], features=wanted))
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(station_pivot(plain, ["station_id", "ts"], features=wanted))))
    sums = colocated.sums(held)
    assert "Exchange" not in plan_of(sums)
    assert sorted(map(str, rows(sums))) == sorted(map(str, rows(daily.daily_sums(plain))))


def test_a_hot_station_is_spread_and_buckets_are_single_files(both):
    _, held, path = both
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 8
    per_file = held.where("station_id = 'hot'").selectExpr("_metadata.file_name AS f").groupBy("f").count().collect()
    assert len(per_file) == 8 and max(r["count"] for r in per_file) < 0.35 * 1500
