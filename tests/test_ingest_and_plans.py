from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.plans import analyses
from stationlake.sources import locations, readings
from stationlake.streaming import ingest
from tests.conftest import rows
from tests.test_sources import write_bare, write_long


def test_land_bare_once(spark, tmp_path):
    raw, out, cp = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "cp")
    write_bare(raw, "17", "pm2.5", "10\n\n30\n")
    write_bare(raw, "17", "o3", "1\n2\n")
    assert ingest.land_bare(spark, str(raw), out, cp) == 4
    assert ingest.land_bare(spark, str(raw), out, cp) == 0
    write_bare(raw, "18", "pm25", "5\n")
    assert ingest.land_bare(spark, str(raw), out, cp) == 1
    got = readings.read_readings(spark, out).select("station_id", "parameter", "ts", "value")
    assert rows(got, "station_id", "parameter", "ts") == [
        ("17", "ozone", datetime(2025, 1, 1, 0), 1.0), ("17", "ozone", datetime(2025, 1, 1, 1), 2.0),
        ("17", "pm25", datetime(2025, 1, 1, 0), 10.0), ("17", "pm25", datetime(2025, 1, 1, 2), 30.0),
        ("18", "pm25", datetime(2025, 1, 1, 0), 5.0)]


def test_land_long_once(spark, tmp_path):
    raw, out, cp, bad = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad")
    write_long(raw, "A_1", "pm25_sensor_7.csv", [
        "2025-01-01 00:00:00,PM2.5,10.5,u,A,1", "2025-01-01 01:00:00,pm2.5,abc,u,A,1"])
    glob = str(raw / "*")
    assert ingest.land_long(spark, glob, out, cp, bad) == 2
    assert ingest.land_long(spark, glob, out, cp, bad) == 0
    write_long(raw, "B_2", "wind_sensor_8.csv", ["2025-01-01 00:00:00,Wind,1,u,B,2"])
    assert ingest.land_long(spark, glob, out, cp, bad) == 1
    got = readings.read_readings(spark, out).select("station_id", "parameter", "value")
    assert rows(got, "station_id") == [("1", "pm25", 10.5), ("2", "wind", 1.0)]
    assert spark.read.parquet(bad).count() == 1


def test_landing_in_bounded_commits(spark, tmp_path):
    raw = tmp_path / "raw"
    for i in range(5):
        write_bare(raw, str(i), "pm25", "1\n2\n")
        write_long(tmp_path / "long", f"A_{i}", "pm25_sensor_1.csv", [f"2025-01-01 00:00:00,pm25,1,u,A,{i}"])
    out = str(tmp_path / "out")
    assert ingest.land_bare(spark, str(raw), out, str(tmp_path / "cp"), max_files=2) == 10
    table = spark.read.parquet(out)
    assert table.count() == 10 and table.select("batch").distinct().count() == 3
    args = str(tmp_path / "long" / "*"), str(tmp_path / "o2"), str(tmp_path / "c2")
    assert ingest.land_long(spark, *args, max_files=2) == 5
    assert spark.read.parquet(args[1]).count() == 5


def test_compare_sources(spark, tmp_path):
    write_bare(tmp_path, "7", "pm2.5", "1\n5\n\n")
    from stationlake.operators.timeline import rebuild_timeline
    from stationlake.sources import bare, pages
    local = rebuild_timeline(bare.read_bare(spark, str(tmp_path)))
    page = {"location_id": 7, "parameter": "PM25", "results": [
        {"value": v, "period": {"datetimeFrom": {"utc": f"2025-01-01T0{h}:00:00Z"}}}
        for h, v in enumerate([1.0, 2.0, 3.0])]}
    (tmp_path / "page.json").write_text(json.dumps(page))
    landed = pages.land_measurements(pages.read_pages(spark, str(tmp_path / "page.json")))
    compared, summary = analyses.compare_sources(landed, local)
    assert rows(compared.select("ts", "a", "b", "status"), "ts") == [
        (datetime(2025, 1, 1, 0), 1.0, 1.0, "match"), (datetime(2025, 1, 1, 1), 2.0, 5.0, "differ"),
        (datetime(2025, 1, 1, 2), 3.0, None, "only_a")]
    assert {r.status: r.n for r in summary.collect()} == {"match": 1, "differ": 1, "only_a": 1}


def test_command_line(spark, network, monkeypatch, tmp_path, capsys):
    from stationlake import __main__ as cli
    loaded, *_ = network
    raw = tmp_path / "long"
    from stationlake.sources import long
    long.write_long(loaded, str(raw))
    density = str(tmp_path / "density")
    spark.createDataFrame([("Sector 62, Noida", 5)], "location_name string, pop_density int").write.parquet(density)
    (tmp_path / "page.json").write_text("{}")
    monkeypatch.setattr(cli, "get_session", lambda **_: spark)
    for command in cli.COMMANDS:
        out = str(tmp_path / command)
        monkeypatch.setattr("sys.argv", ["stationlake", command, "--layout", "long", "--raw", str(raw),
                                         "--density", density, "--pages", str(tmp_path / "page.json"), "--out", out])
        cli.main()
    assert spark.read.parquet(str(tmp_path / "pca" / "kpi")).count() == 1
    assert spark.read.parquet(str(tmp_path / "stations" / "stations")).count() == 3
    assert spark.read.parquet(str(tmp_path / "coverage" / "coverage")).count() == 18 * 13
    assert spark.read.parquet(str(tmp_path / "violations" / "heatmap")).count() == 3


def test_load_long_and_align(spark, tmp_path):
    hour = "2024-02-28 05:00:00"
    write_long(tmp_path, "A_1", "all.csv", [
        f"{hour},PM2.5,1,u,A,1", f"{hour},pm25,3,u,A,1", f"{hour},no2,5,u,A,1",
        "2023-02-28 05:00:00,no2,7,u,A,1", "2024-02-29 05:00:00,no2,9,u,A,1", f"{hour},no2,x,u,A,1",
        "not a time,no2,1,u,A,1", f"{hour},no2,4,u,B,2"])
    loaded, rejects = analyses.load_long(spark, str(tmp_path / "*"))
    assert rejects.count() == 2 and loaded.count() == 6
    got = analyses.aligned_features(loaded, features=["pm25", "no2"])
    assert rows(got) == [("A", datetime(2025, 2, 28, 5), 2.0, 6.0)]


@pytest.fixture(scope="module")
def network(spark, tmp_path_factory):
    """Three stations with six parameters over 60 hours, some lines blank."""
    root = tmp_path_factory.mktemp("net")
    rng = np.random.default_rng(0)
    names = {"1": "Manali Village, Chennai", "2": "Sector 62, Noida", "3": "Talkatora, Lucknow"}
    files = ["pm25", "pm10", "no2", "o3", "temperature", "relativehumidity"]
    series = {}
    for s in names:
        for f in files:
            v = rng.gamma(2, 40 if s != "2" else 15, 60).round(1).tolist()
            text = ["" if (i + int(s)) % 13 == 0 else str(x) for i, x in enumerate(v)]
            series[s, f] = [float(x) if x else None for x in text]
            write_bare(root / "raw", s, f, "\n".join(text) + "\n")
    write_bare(root / "raw", "2", "wind", "1\n2\n")
    write_bare(root / "raw", "99", "pm25", "1\n2\n")
    meta = root / "meta.json"
    meta.write_text(json.dumps([{"id": int(k), "name": n, "sensors": []} for k, n in names.items()]))
    loaded = analyses.load_bare(spark, str(root / "raw"), str(meta))
    name_table = locations.station_names(locations.read_locations(spark, str(meta)))
    return loaded, name_table, series, names


def test_load(network):
    loaded, _, series, _ = network
    assert loaded.count() == sum(x is not None for v in series.values() for x in v)
    assert {r[0] for r in loaded.select("parameter").distinct().collect()} == {
        "pm25", "pm10", "no2", "ozone", "temperature", "humidity"}


def test_pca_analysis(network):
    loaded, _, series, names = network
    result = analyses.pca_analysis(loaded)
    data, zones = [], []
    for s in names:
        for h in range(60):
            row = [series[s, f][h] for f in ("pm25", "pm10", "no2", "o3", "temperature", "relativehumidity")]
            if None not in row:
                data.append(row)
                zones.append("Residential" if s == "2" else "Industrial")
    data = np.array(data)
    assert result.model.n == len(data) == result.scores.count()
    values = np.linalg.eigvalsh(np.corrcoef(data.T))[::-1]
    assert result.model.ratios == pytest.approx((values[:2] / 6).tolist())
    z = (data - data.mean(0)) / data.std(0)
    scores = z @ np.array(result.model.weights).T
    centre = {k: scores[np.array(zones) == k].mean(0) for k in set(zones)}
    gap = np.linalg.norm(centre["Industrial"] - centre["Residential"])
    assert result.separation.first().centroid_gap == pytest.approx(gap)
    kpi = result.kpi.first()
    assert kpi.records == len(data) and kpi.centroid_gap == pytest.approx(gap)
    assert result.loadings.count() == 6 and result.variance.count() == 2
    assert sum(r.n for r in result.centroids.collect()) == len(data)


def test_violation_analysis(network):
    loaded, names, series, _ = network
    got = {r.label: r.Jan for r in analyses.violation_analysis(loaded, names).collect()}
    for s, label in (("1", "Manali Village"), ("2", "Sector 62"), ("3", "Talkatora")):
        v = [x for x in series[s, "pm25"] if x is not None]
        assert got[label] == pytest.approx(np.mean(np.array(v) > 35))


def test_tail_analysis(network):
    loaded, _, series, _ = network
    result = analyses.tail_analysis(loaded, "Sector 62, Noida")
    v = np.array([x for x in series["2", "pm25"] if x is not None])
    kpi = result.kpi.first()
    assert (kpi.station, kpi.n) == ("Sector 62, Noida", len(v))
    assert kpi.p99 == pytest.approx(np.percentile(v, 99))
    assert result.exceedance.first().exceedance == pytest.approx(np.mean(v > np.percentile(v, 99)))
    assert result.histogram.agg(F.sum("n")).first()[0] == len(v)
    curve = rows(result.survival.select("x", "survival"), "x")
    assert curve == [(x, pytest.approx(max(1e-6, np.mean(v > x)))) for x in np.unique(v)]
    assert result.tail.count() == len(np.unique(v[v >= 200]))
    assert analyses.tail_analysis(loaded).kpi.count() == 1


def test_exposure_analysis(spark, network):
    loaded, names, series, label = network
    density = spark.createDataFrame([(n, 10 * i) for i, n in enumerate(label.values())],
                                    "location_name string, pop_density int")
    got = {r.location_name: r for r in analyses.exposure_analysis(loaded, names, density).collect()}
    v = [x for x in series["1", "pm25"] if x is not None]
    assert got["Manali Village, Chennai"].pm25_mean == pytest.approx(np.mean(v))
    assert got["Sector 62, Noida"].pop_density == 10 and len(got) == 3
