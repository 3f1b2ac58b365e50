from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stationlake.functions.vocabulary import parameter_dim
from stationlake.operators import completeness, timeline
from stationlake.sources import bare, locations, long, pages, readings, shared
from tests.conftest import rows


def sensor(sid, pid, name):
    return {"id": sid, "parameter": {"id": pid, "name": name, "units": "u"}}


@pytest.fixture
def metadata(tmp_path):
    full = [sensor(10 + i, p, n) for i, (p, n) in enumerate(
        [(2, "pm25"), (1, "pm10"), (15, "no2"), (5, "no2"), (3, "o3"), (100, "temperature"),
         (98, "humidity"), (77, "wind")])]
    data = [
        {"id": 17, "name": "North Gate, Delhi", "sensors": full, "extra": 1},
        {"id": 18, "name": "Partial", "sensors": full[:6]},
        {"id": 19, "name": "Late, City", "sensors": full},
        {"id": 20, "name": "No sensors"},
    ]
    path = tmp_path / "locations.json"
    path.write_text(json.dumps(data, indent=2))
    return str(path)


def test_locations(spark, metadata, tmp_path):
    locs = locations.read_locations(spark, metadata)
    assert rows(locations.station_names(locs), "station_id")[0] == ("17", "North Gate, Delhi")
    assert [r[2] for r in rows(locations.sensor_counts(locs), "id")] == [8, 6, 8, 0]
    assert locations.explode_sensors(locs).count() == 22
    assert [r.id for r in completeness.discover_locations(locs).orderBy("id").collect()] == [17, 19]
    assert [r.id for r in completeness.discover_locations(locs, count=1).collect()] == [17]
    out = str(tmp_path / "lines")
    locations.write_locations(locs, out)
    again = locations.read_locations(spark, out, multiline=False)
    assert rows(again, "id") == rows(locs, "id")


def test_first_sensor_and_lookup(spark, metadata):
    locs = locations.read_locations(spark, metadata)
    firsts = completeness.first_sensors(locs.filter("id = 17"))
    assert {r.param_group: r.sensor_id for r in firsts.collect()} == {
        "pm25": 10, "pm10": 11, "no2": 12, "ozone": 14, "temperature": 15, "humidity": 16}
    flat = completeness.sensor_groups(locations.explode_sensors(locs), parameter_dim(spark))
    assert flat.filter("param_name = 'wind'").count() == 0
    by_row = completeness.first_per_group(flat, ["location_id", "param_group"], "pos")
    assert rows(by_row.select("location_id", "param_group", "sensor_id"), "location_id", "param_group") == rows(
        completeness.first_sensors(locs).select("location_id", "param_group", "sensor_id"),
        "location_id", "param_group")
    assert rows(completeness.lookup_sensor(locs, 17)) == [(17, "North Gate, Delhi", 10)]
    assert rows(completeness.lookup_sensor(locs, 20)) == [(20, "No sensors", None)]


def write_bare(root, station, name, text):
    folder = root / f"station={station}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv").write_text(text)


def test_blank_line_keeps_its_hour(spark, tmp_path):
    write_bare(tmp_path, "007", "pm2.5", "10\n\n30\nnan\n50")
    tl = timeline.rebuild_timeline(bare.read_bare(spark, str(tmp_path)))
    assert rows(tl.select("station_id", "parameter", "ts", "value", "row_idx"), "row_idx") == [
        ("007", "pm2.5", datetime(2025, 1, 1, 0), 10.0, 1),
        ("007", "pm2.5", datetime(2025, 1, 1, 2), 30.0, 3),
        ("007", "pm2.5", datetime(2025, 1, 1, 4), 50.0, 5),
    ]
    kept = timeline.rebuild_timeline(bare.read_bare(spark, str(tmp_path)), drop_missing=False)
    assert kept.count() == 5


def test_line_order_of_a_file_read_in_many_splits(spark, tmp_path, conf):
    conf("spark.sql.files.maxPartitionBytes", "20000")
    conf("spark.sql.files.openCostInBytes", "4000")
    write_bare(tmp_path, "1", "o3", "".join("\n" if i % 7 == 0 else f"{i}\n" for i in range(1, 30001)))
    write_bare(tmp_path, "2", "o3", "".join(f"{i}\n" for i in range(1, 101)))
    raw = bare.read_bare(spark, str(tmp_path))
    assert raw.select("source_file", "block_start").distinct().count() > 5
    numbered = timeline.line_numbers(raw)
    assert numbered.count() == 30100
    assert numbered.filter("value <> row_idx").count() == 0
    assert numbered.filter("value IS NULL AND row_idx % 7 <> 0").count() == 0
    scan = timeline.scan_positions(raw)
    assert scan.select("rn").distinct().count() == 30100
    assert scan.filter("station_id = '2' AND value + 30000 <> rn").count() == 0


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, conf):
    write_bare(tmp_path, "1", "no2", "".join(f"{i % 97}\n" for i in range(20000)))
    whole = rows(timeline.line_numbers(bare.read_bare(spark, str(tmp_path))).select("row_idx", "value"), "row_idx")
    conf("spark.sql.files.maxPartitionBytes", "7001")
    split = rows(timeline.line_numbers(bare.read_bare(spark, str(tmp_path))).select("row_idx", "value"), "row_idx")
    assert whole == split


def test_line_numbers_survive_another_cut_of_the_files(spark, tmp_path, conf):
    """The splits may be cut differently when the result is finally read."""
    write_bare(tmp_path, "1", "no2", "".join(f"{i}\n" for i in range(1, 20001)))
    conf("spark.sql.files.maxPartitionBytes", "9000")
    numbered = timeline.line_numbers(bare.read_bare(spark, str(tmp_path)))
    scan = timeline.scan_positions(bare.read_bare(spark, str(tmp_path)))
    conf("spark.sql.files.maxPartitionBytes", "30011")
    conf("spark.sql.files.minPartitionNum", "3")
    assert numbered.filter("value = row_idx").count() == 20000
    assert scan.filter("value = rn").count() == 20000


def test_pruning(spark, tmp_path):
    for s in ("1", "17", "2"):
        write_bare(tmp_path, s, "pm25", "1\n")
        write_bare(tmp_path, s, "pm10", "2\n")
    one = bare.read_bare(spark, str(tmp_path), stations=[17])
    assert {r.station_id for r in one.collect()} == {"17"} and one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "17" in plan.split("PartitionFilters")[1]
    pm10 = bare.read_bare(spark, str(tmp_path), file_filter="pm10.csv")
    assert {r.parameter for r in pm10.collect()} == {"pm10"}


def test_read_lines_takes_ids_from_the_path(spark, tmp_path):
    write_bare(tmp_path, "5", "temperature", "1\n2\n")
    flat = bare.read_lines(spark, str(tmp_path / "station=5"))
    assert {(r.station_id, r.parameter) for r in flat.collect()} == {("5", "temperature")}


HEADER = "timestamp,parameter,value,units,location_name,location_id\n"


def write_long(root, folder, name, lines):
    d = root / folder
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text(HEADER + "".join(line + "\n" for line in lines))


def test_long_csv_keeps_good_rows_and_reports_bad_ones(spark, tmp_path):
    write_long(tmp_path, "A_1", "pm25_sensor_7.csv", [
        "2025-01-01 00:00:00,pm25,10.5,u,\"A, City\",1",
        "2025-01-01 01:00:00,pm25,abc,u,\"A, City\",1",
        "2025-01-01 02:00:00,pm25,nan,u,\"A, City\",1",
        "oops,pm25,3,u,\"A, City\",1",
        "2025-01-01 04:00:00,pm25,,u,\"A, City\",1",
    ])
    good, rejects = long.read_long(spark, str(tmp_path / "*"))
    assert good.count() == 3
    assert sorted(r.line.split(",")[0] for r in rejects.collect()) == ["2025-01-01 01:00:00", "oops"]
    table = long.to_readings(good)
    assert rows(table.select("station_id", "location_name", "ts", "value"), "ts") == [
        ("1", "A, City", datetime(2025, 1, 1, 0), 10.5),
        ("1", "A, City", datetime(2025, 1, 1, 2), None),
        ("1", "A, City", datetime(2025, 1, 1, 4), None),
    ]
    out = str(tmp_path / "export")
    long.write_long(table, out)
    again = long.to_readings(long.read_long(spark, out)[0])
    assert rows(again.select("ts", "value"), "ts") == rows(table.select("ts", "value"), "ts")


def test_pages(spark, tmp_path):
    page = {"location_id": 3, "location_name": "A", "parameter": "o3", "units": "u", "results": [
        {"value": 1.5, "period": {"datetimeFrom": {"utc": "2025-01-01T00:00:00Z", "local": "x"}}},
        {"value": 2.5, "period": {"datetimeFrom": "2025-01-01T01:00:00Z"}},
        {"value": 3.5, "period": None},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n" + json.dumps({"location_id": 4, "results": []}))
    got = pages.land_measurements(pages.read_pages(spark, str(tmp_path / "p.json")))
    assert rows(got.select("station_id", "parameter", "ts", "value"), "ts") == [
        ("3", "o3", datetime(2025, 1, 1, 0), 1.5), ("3", "o3", datetime(2025, 1, 1, 1), 2.5)]


def table(spark, data):
    return spark.createDataFrame(
        data, "station_id string, parameter string, ts timestamp, value double")


def test_readings_table(spark, tmp_path):
    path = str(tmp_path / "readings")
    t = datetime(2025, 1, 1)
    from stationlake import schemas
    from stationlake.functions.values import conform
    first = table(spark, [("1", "pm25", t, 1.0), ("2", "pm25", t, 2.0), ("1", "no2", t, 3.0)])
    readings.write_readings(conform(first, schemas.READINGS), path)
    assert readings.read_readings(spark, path).count() == 3
    pruned = readings.read_readings(spark, path, ["pm25"], [2])
    assert rows(pruned.select("station_id", "value")) == [("2", 2.0)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "pm25" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(station_id,2)" in plan or "In(station_id" in plan
    # A re-fetched series replaces itself only.
    again = table(spark, [("9", "no2", t, 9.0), ("2", "pm25", t, 8.0)])
    readings.write_readings(conform(again, schemas.READINGS), path)
    landed = readings.read_readings(spark, path).select("station_id", "parameter", "value")
    assert rows(landed, "station_id", "parameter") == [
        ("1", "no2", 3.0), ("1", "pm25", 1.0), ("2", "pm25", 8.0), ("9", "no2", 9.0)]
    # "overwrite" replaces the folders of its parameters.
    readings.write_readings(conform(table(spark, [("9", "no2", t, 9.0)]), schemas.READINGS), path, "overwrite")
    assert rows(readings.read_readings(spark, path).select("station_id", "parameter"), "station_id") == [
        ("1", "pm25"), ("2", "pm25"), ("9", "no2")]


def test_long_csv_is_the_same_for_any_columns_and_header(spark, tmp_path):
    write_long(tmp_path, "A_1", "a.csv", [
        "2025-01-01 00:00:00,pm25,5,u,A,S-17", "2025-01-01 01:00:00,pm25,5", "a,b,c,d,e,f,g,h",
        "2025-01-01 02:00:00,pm25,5,u,A,1,extra",
    ])
    swapped = tmp_path / "B_2"
    swapped.mkdir()
    (swapped / "b.csv").write_text(
        "location_id,units,value,timestamp,parameter\n"
        "2,ug,7,\"{'utc': '2025-01-01T03:00:00Z', 'local': 'x'}\",no2\n2,ug,8,2025-01-01 04:00:00.250,no2\n"
    )
    good, rejects = long.read_long(spark, str(tmp_path / "*"))
    assert good.count() == len(good.collect()) == 3 and rejects.count() == len(rejects.collect()) == 3
    assert good.agg({"value": "sum"}).first()[0] == 20.0
    read = long.to_readings(good)
    assert rows(read.select("station_id", "parameter", "value", "units"), "value") == [
        ("S-17", "pm25", 5.0, "u"), ("2", "no2", 7.0, "ug"), ("2", "no2", 8.0, "ug")]
    out = str(tmp_path / "export")
    long.write_long(read, out)
    again = long.to_readings(long.read_long(spark, out)[0])
    assert rows(again.select("station_id", "ts", "value"), "value") == rows(
        read.select("station_id", "ts", "value"), "value")


def test_new_only_and_attach(spark):
    t = datetime(2025, 1, 1)
    new = table(spark, [("1", "pm25", t, 1.0), ("2", "pm25", t, 2.0)])
    landed = table(spark, [("1", "pm25", t, 0.0), ("1", "pm25", t, 0.0)])
    assert rows(readings.new_only(new, landed, ["station_id", "parameter"]).select("station_id")) == [("2",)]
    names = spark.createDataFrame([("2", "B")], "station_id string, location_name string")
    assert rows(readings.attach_location(new, names).select("station_id", "location_name")) == [("2", "B")]


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        def getCheckpointDir(self):
            return None
    class Session:
        sparkContext = Context()
        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_staged_table_is_written_to_the_shared_folder(spark):
    kept = shared.staged(spark.range(5).withColumn("x", F.lit("a")), "probe")
    assert kept.count() == 5
    assert kept.inputFiles()[0].split("://")[-1].replace("file:", "").lstrip("/").startswith(
        shared.shared_folder(spark).replace("file:", "").lstrip("/"))
