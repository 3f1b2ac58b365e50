"""Snapshots of the readings table: atomic commits, landing once, compaction, old versions."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions.values import conform
from stationlake.sources import readings, snapshots
from stationlake.streaming import ingest
from tests.conftest import rows
from tests.test_sources import write_long

T0 = datetime(2025, 1, 1)


def table(spark, data):
    """Readings from (station, parameter, value), an hour apart."""
    timed = [(s, p, T0 + timedelta(hours=k), float(v)) for k, (s, p, v) in enumerate(data)]
    return conform(spark.createDataFrame(timed, "station_id string, parameter string, ts timestamp, value double"), schemas.READINGS)


def landed(spark, path, **more):
    return rows(readings.read_readings(spark, path, **more).select("station_id", "parameter", "value"), "parameter", "station_id", "value")


def test_a_write_that_fails_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    readings.write_readings(table(spark, [("1", "pm25", 1), ("2", "pm25", 2), ("1", "no2", 3)]), path)
    before = landed(spark, path)

    def lost(*_):
        raise RuntimeError("driver lost")

    for mode in ("replace", "overwrite", "append"):
        with monkeypatch.context() as m:
            m.setattr(snapshots, "_publish", lost)
            with pytest.raises(RuntimeError, match="lost"):
                readings.write_readings(table(spark, [("2", "pm25", 9), ("3", "no2", 9)]), path, mode)
        assert landed(spark, path) == before
    readings.write_readings(table(spark, [("2", "pm25", 9), ("3", "no2", 9)]), path)
    assert landed(spark, path) == [("1", "no2", 3.0), ("3", "no2", 9.0), ("1", "pm25", 1.0), ("2", "pm25", 9.0)]
    assert landed(spark, path, version=1) == before
    with pytest.raises(ValueError, match="no version"):
        readings.read_readings(spark, path, version=7)


def test_a_half_written_manifest_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    readings.write_readings(table(spark, [("1", "pm25", 1)]), path)
    (tmp_path / "t" / "_snapshots" / ".2-abc").write_text('{"entries": [')
    assert landed(spark, path) == [("1", "pm25", 1.0)]
    readings.write_readings(table(spark, [("2", "pm25", 2)]), path, "append")
    assert snapshots.versions(spark, path) == [1, 2] and len(landed(spark, path)) == 2


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    readings.write_readings(table(spark, [("1", "pm25", 1), ("1", "no2", 1)]), path)
    write = snapshots.write_folder

    def meet(other):
        """Another writer commits after this one has read the table, before it commits."""
        def slow(*args, **more):
            out = write(*args, **more)
            monkeypatch.setattr(snapshots, "write_folder", write)
            other()
            return out
        monkeypatch.setattr(snapshots, "write_folder", slow)

    meet(lambda: readings.write_readings(table(spark, [("5", "o3", 5)]), path))
    readings.write_readings(table(spark, [("2", "pm25", 2)]), path)  # other parameters: both stay
    meet(lambda: readings.write_readings(table(spark, [("6", "pm25", 6)]), path, "append"))
    with pytest.raises(snapshots.Conflict):
        readings.write_readings(table(spark, [("7", "pm25", 7)]), path)
    assert landed(spark, path) == [("1", "no2", 1.0), ("5", "o3", 5.0), ("1", "pm25", 1.0), ("2", "pm25", 2.0), ("6", "pm25", 6.0)]
    with pytest.raises(snapshots.Conflict):
        snapshots._publish(spark, path, snapshots.Snapshot(1))


def test_awkward_parameters_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("1", None, 1), (None, "a/b=c %20é", 2), ("1", "", 3), (None, None, 4)]
    readings.write_readings(table(spark, first), path)
    readings.write_readings(table(spark, [(None, None, 5), (None, "a/b=c %20é", 6)]), path)
    got = sorted(map(str, landed(spark, path)))
    # Spark writes an empty partition value as a null one.
    assert got == sorted(map(str, [("1", None, 1.0), (None, "a/b=c %20é", 6.0), ("1", None, 3.0), (None, None, 5.0)]))
    assert landed(spark, path, parameters=["a/b=c %20é"]) == [(None, "a/b=c %20é", 6.0)]


def test_empty_writes_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    readings.write_readings(table(spark, [("1", "pm25", 1)]).limit(0), path)
    assert snapshots.snapshot(spark, path) is None and readings.compact_readings(spark, path) == 0
    assert snapshots.vacuum(spark, path) == 0
    readings.write_readings(table(spark, [("1", "pm25", 1)]), path)
    readings.write_readings(table(spark, [("1", "pm25", 1)]).limit(0), path)
    assert landed(spark, path) == [("1", "pm25", 1.0)] and landed(spark, path, parameters=["none"]) == []


def test_a_folder_without_manifest_is_read_and_adopted(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, [("1", "pm25", 1), ("2", "no2", 2)]).write.partitionBy("parameter").parquet(path)
    assert landed(spark, path) == [("2", "no2", 2.0), ("1", "pm25", 1.0)]
    readings.write_readings(table(spark, [("3", "pm25", 3)]), path)
    assert landed(spark, path) == [("2", "no2", 2.0), ("1", "pm25", 1.0), ("3", "pm25", 3.0)]


def test_fifty_small_batches_stay_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    most = 0
    for k in range(50):
        batch = table(spark, [(str(k % 7), "pm25", k), (str(k % 3), "no2" if k % 2 else "o3", k)]).coalesce(1)
        assert snapshots.land(spark, path, batch, "parameter", "s", k)
        readings.compact_readings(spark, path, fan=4)
        held = snapshots.snapshot(spark, path)
        most = max(most, *(sum(e.files for e in held.of([p])) for p in ("pm25", "no2", "o3") if held.of([p])))
    assert most <= 3 * 3  # below fan folders in each of three levels, one file each
    want = sorted([(str(k % 7), "pm25", float(k)) for k in range(50)] + [(str(k % 3), "no2" if k % 2 else "o3", float(k)) for k in range(50)])
    assert sorted(landed(spark, path)) == want
    assert landed(spark, path, parameters=["pm25"], stations=["3"]) == [("3", "pm25", float(k)) for k in range(3, 50, 7)]
    # The merged files are in order of station and time.
    merged = max(snapshots.snapshot(spark, path).of(["pm25"]), key=lambda e: e.level)
    held = [tuple(r) for r in spark.read.parquet(f"{path}/{merged.folder}").select("station_id", "ts").collect()]
    assert merged.level == 2 and held == sorted(held)


def test_a_batch_lands_once_and_sources_do_not_meet(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = table(spark, [("1", "pm25", 1)])
    assert snapshots.land(spark, path, batch, "parameter", "a", 0)
    assert not snapshots.land(spark, path, batch, "parameter", "a", 0)
    assert snapshots.land(spark, path, batch, "parameter", "b", 0)
    assert landed(spark, path) == [("1", "pm25", 1.0)] * 2


def test_landing_again_after_a_failure_between_commits(spark, tmp_path, monkeypatch):
    raw, out, cp = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "cp")
    write_long(raw, "A_1", "a.csv", ["2025-01-01 00:00:00,PM2.5,10.5,u,A,1"])
    done = snapshots.commit

    def then_lost(*args, **more):
        done(*args, **more)
        raise RuntimeError("lost after the commit")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", then_lost)
        with pytest.raises(Exception, match="lost after"):
            ingest.land_long(spark, str(raw / "*"), out, cp)
    assert landed(spark, out) == [("1", "pm25", 10.5)]
    write_long(raw, "A_1", "b.csv", ["2025-01-01 01:00:00,PM2.5,11.5,u,A,1"])
    ingest.land_long(spark, str(raw / "*"), out, cp)  # runs the first batch again, adds nothing, then the second
    assert landed(spark, out) == [("1", "pm25", 10.5), ("1", "pm25", 11.5)]
    # A checkpoint set up anew is another stream: its first batch is not taken for the old one.
    ingest.land_long(spark, str(raw / "*"), out, str(tmp_path / "cp2"))
    assert len(landed(spark, out)) == 4


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in range(4):
        readings.write_readings(table(spark, [("1", "pm25", v)]), path)
    assert snapshots.vacuum(spark, path, keep=2) == 0  # too young
    for name in os.listdir(path):
        if name.startswith("batch="):
            os.utime(f"{path}/{name}", (0, 0))
    assert snapshots.vacuum(spark, path, keep=2) == 2
    assert snapshots.versions(spark, path) == [3, 4]
    assert landed(spark, path) == [("1", "pm25", 3.0)] and landed(spark, path, version=3) == [("1", "pm25", 2.0)]


def test_compaction_does_not_undo_a_replacement(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for v in range(3):
        readings.write_readings(table(spark, [("1", "pm25", v)]), path, "append")
    write = snapshots.write_folder

    def slow(*args, **more):
        out = write(*args, **more)
        monkeypatch.setattr(snapshots, "write_folder", write)
        readings.write_readings(table(spark, [("1", "pm25", 9)]), path)
        return out

    monkeypatch.setattr(snapshots, "write_folder", slow)
    with pytest.raises(snapshots.Conflict):
        readings.compact_readings(spark, path, fan=3)
    assert landed(spark, path) == [("1", "pm25", 9.0)]
    assert readings.read_readings(spark, path).filter(F.col("value") == 9).count() == 1
