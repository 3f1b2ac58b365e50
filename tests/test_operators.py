from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.operators import (
    completeness, exposure, pca, reconcile, tails, timeline, violations, wide,
)
from tests.conftest import rows

NAN = float("nan")


def numbers(spark, data, column="value"):
    return spark.createDataFrame([(v,) for v in data], f"{column} double")


# --- wide -------------------------------------------------------------------

def test_pivot_and_complete_cases(spark):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame(
        [("A", t, "pm25", 1.0), ("A", t, "pm25", 3.0), ("A", t, "no2", 5.0), ("B", t, "pm25", NAN),
         ("B", t, "no2", 2.0), ("B", t, "other", 9.0), ("C", t, "other", 9.0)],
        "location_name string, ts timestamp, parameter string, value double")
    wide_rows = wide.station_pivot(df, ["location_name", "ts"], features=["pm25", "no2", "pm10"])
    assert rows(wide_rows.drop("ts"), "location_name") == [("A", 2.0, 5.0, None), ("B", None, 2.0, None)]
    assert rows(wide.complete_cases(wide_rows, ["pm25", "no2"]).select("location_name")) == [("A",)]
    assert rows(wide.null_report(wide_rows, ["pm25", "no2", "pm10"])) == [("pm25", 1), ("no2", 0), ("pm10", 2)]
    assert rows(wide.completeness_counts(wide_rows, ["pm25", "no2"])) == [(2, 1, 1)]
    assert rows(wide.table_size(df, "location_name")) == [(7, 3)]
    assert rows(wide.table_size(df, "location_name", approx=True)) == [(7, 3)]


# --- violations -------------------------------------------------------------

def test_violation_rate_and_null_rule(spark):
    df = numbers(spark, [35.0, 35.1, None, 80.0]).withColumn("s", F.lit(1))
    assert rows(violations.violation_rate(df, ["s"])) == [(1, 2 / 3, 3)]
    assert rows(violations.violation_rate(df, ["s"], null_as_safe=True)) == [(1, 0.5, 4)]


def test_heatmap(spark):
    jan, feb = datetime(2025, 1, 5), datetime(2025, 2, 5)
    df = spark.createDataFrame(
        [("1", jan, 50.0)] + [("1", feb, 1.0)] * 3 + [("2", jan, 99.0), ("3", jan, 2.0), ("9", jan, 99.0)],
        "station_id string, ts timestamp, value double")
    names = spark.createDataFrame(
        [("1", "North, City"), ("2", "South, City"), ("3", "South, Town")],
        "station_id string, location_name string")
    got = violations.violation_heatmap(df, names=names, rank=True).collect()
    assert [(r.label, r.Jan, r.Feb, r.Mar, r.row_mean, r["rank"]) for r in got] == [
        ("North", 1.0, 0.0, None, 0.5, 1), ("South", 0.5, None, None, 0.5, 2)]
    assert len(got[0]) == 15
    named = violations.violation_heatmap(df.withColumn("station_id", F.lit("East, City"))).collect()
    assert [(r.label, r.Jan) for r in named] == [("East", 0.75)]
    plain = violations.violation_heatmap(df, names=names).collect()
    assert [r.label for r in plain] == ["North", "South"]


# --- tails ------------------------------------------------------------------

def test_survival(spark):
    df = numbers(spark, [-1.0, 0.0, NAN, 1.0, 2.0, 2.0, 4.0, None])
    curve = tails.survival_curve(df)
    assert rows(curve.select("x", "survival"), "x") == [(1.0, 0.75), (2.0, 0.25), (4.0, 1e-6)]
    assert rows(tails.survival_tail(curve, 2).select("x"), "x") == [(2.0,), (4.0,)]


def test_tail_stats(spark):
    df = numbers(spark, [float(i) for i in range(1, 101)] + [-5.0, NAN, None])
    r = tails.tail_stats(df, limit=90).first()
    assert (r.n, r.count_ext, r.pct_ext) == (100, 10, 10.0)
    assert r.p99 == pytest.approx(99.01) and r.skewness == pytest.approx(0, abs=1e-12)
    small = tails.tail_stats(numbers(spark, [1.0, 2.0, 6.0])).first()
    assert small.skewness == pytest.approx(0.595170, abs=1e-6)
    empty = tails.tail_stats(numbers(spark, [-1.0])).first()
    assert (empty.n, empty.p99, empty.pct_ext, empty.skewness) == (0, None, 0.0, None)
    single = tails.tail_stats(numbers(spark, [7.0])).first()
    assert (single.n, single.p99, single.skewness) == (1, 7.0, None)
    assert tails.tail_stats(df, approx=True).first().p99 == pytest.approx(99, abs=1)


def test_tail_stats_by_group_with_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 300.0), (None, 5.0)], "g string, value double")
    got = {r.g: (r.n, r.p99, r.count_ext) for r in tails.tail_stats(df, by=["g"]).collect()}
    assert got == {"a": (2, pytest.approx(297.01), 1), None: (1, 5.0, 0)}


def test_exceedance_counts_every_row(spark):
    df = numbers(spark, [float(i) for i in range(1, 101)] + [-1.0] * 99 + [None])
    r = tails.exceedance_at(df).first()
    assert (r.q, r.exceedance, r.n_all) == (pytest.approx(99.01), 1 / 200, 200)


def test_histogram(spark):
    data = [0.0, 1.0, 1.0, 5.0, 10.0, NAN, None]
    got = rows(tails.histogram(numbers(spark, data), bins=5).select("bin", "n"), "bin")
    assert got == [(0, 3), (2, 1), (4, 1)]
    full = rows(tails.histogram(numbers(spark, data), bins=5, fill=True), "bin")
    counts, edges = np.histogram([0, 1, 1, 5, 10], bins=5)
    assert [r[3] for r in full] == counts.tolist()
    assert [r[1] for r in full] == pytest.approx(edges[:-1].tolist())
    flat = rows(tails.histogram(numbers(spark, [3.0, 3.0]), bins=5))
    assert [(r[0], r[3]) for r in flat] == [(0, 2)]
    assert rows(tails.histogram(numbers(spark, []), bins=5)) == []


def test_histogram_freedman_diaconis(spark):
    rng = np.random.default_rng(5)
    data = rng.gamma(2, 40, 2000).round(2)
    got = rows(tails.histogram(numbers(spark, data.tolist()), bins="fd"), "bin")
    edges = np.histogram_bin_edges(data, bins="fd")
    assert sum(r[3] for r in got) == 2000
    assert got[-1][0] == len(edges) - 2
    counts, _ = np.histogram(data, bins=edges)
    assert {r[0]: r[3] for r in got} == {i: c for i, c in enumerate(counts.tolist()) if c}


def test_kpi_tail(spark):
    df = spark.createDataFrame(
        [("Long station name, in a big city", 250.0)] * 2 + [("B", 1.0)], "location_name string, value double")
    r = tails.kpi_tail(df).first()
    assert r.station == "Long station name, in a big " and (r.n, r.count_ext) == (2, 2)
    assert tails.kpi_tail(df, target="B").first().n == 1


# --- completeness -----------------------------------------------------------

def test_stations_with_all_and_counts(spark):
    df = spark.createDataFrame(
        [("A", "x"), ("A", "y"), ("A", "y"), ("B", "x")], "s string, parameter string")
    assert rows(completeness.stations_with_all(df, ["s"], at_least=2)) == [("A", 2)]
    assert rows(completeness.parameter_counts(df), "parameter") == [("x", 2), ("y", 2)]


def test_missing_report(spark):
    df = spark.createDataFrame(
        [("A", "pm25", 1.0), ("A", "pm25", NAN), ("A", "no2", None), ("B", "no2", 1.0)],
        "location_name string, parameter string, value double")
    got = completeness.missing_report(df, expected=["pm25", "no2"])
    assert rows(got, "location_name") == [
        ("A", ["no2", "pm25"], 2, 2, 1, []), ("B", ["no2"], 1, 1, 1, ["pm25"])]
    zoned = completeness.missing_report(
        df.withColumn("location_name", F.concat("location_name", F.lit(" Manali"))), ruleset="narrow")
    assert {r.zone for r in zoned.collect()} == {"Industrial"}


def hours(spark, station_hours):
    t0 = datetime(2025, 1, 1)
    return spark.createDataFrame(
        [(s, t0 + timedelta(hours=h)) for s, h in station_hours], "station_id string, ts timestamp")


def test_coverage(spark):
    seen = [("A", h) for h in range(48)] + [("A", 5), ("B", 30), ("C", 5000), ("C", -3)]
    got = completeness.coverage(hours(spark, seen), "2025-01-01", "2025-01-03 12:00:00", window_days=1)
    assert [(r.station_id, r.win, r.observed, r.expected, r.status) for r in got.orderBy("station_id", "win").collect()] == [
        ("A", 0, 24, 24, "full"), ("A", 1, 24, 24, "full"), ("A", 2, 0, 12, "missing"),
        ("B", 0, 0, 24, "missing"), ("B", 1, 1, 24, "partial"), ("B", 2, 0, 12, "missing"),
        ("C", 0, 0, 24, "missing"), ("C", 1, 0, 24, "missing"), ("C", 2, 0, 12, "missing")]


def test_missing_hours(spark):
    t0 = datetime(2025, 1, 1)
    h = lambda n: t0 + timedelta(hours=n)
    seen = [("A", i) for i in range(6)] + [("A", 3), ("B", 1), ("B", 4), ("C", 99)]
    got = completeness.missing_hours(hours(spark, seen), "2025-01-01", "2025-01-01 06:00:00")
    assert rows(got, "station_id", "gap_start") == [
        ("B", h(0), h(1), 1), ("B", h(2), h(4), 2), ("B", h(5), h(6), 1), ("C", h(0), h(6), 6)]


# --- pca --------------------------------------------------------------------

def features(spark, n=400, d=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 1))
    data = base * np.linspace(1, 0.2, d) + rng.normal(size=(n, d)) * np.linspace(0.3, 1.5, d) + 5
    cols = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, "Industrial" if b > 0 else "Residential", *r) for i, (b, r) in
                                enumerate(zip(base[:, 0].tolist(), data.tolist()))], ["id", "zone", *cols])
    return df, data, cols


def test_pca_equals_eigh(spark):
    df, data, cols = features(spark)
    model = pca.fit_pca(df, cols)
    values, vectors = np.linalg.eigh(np.corrcoef(data.T))
    z = (data - data.mean(0)) / data.std(0)
    for j in (0, 1):
        v = vectors[:, -1 - j]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert model.weights[j] == pytest.approx(v.tolist(), abs=1e-9)
        assert model.ratios[j] == pytest.approx(values[-1 - j] / values.sum())
        got = [r[0] for r in pca.project(df, model).orderBy("id").select(f"PC{j + 1}").collect()]
        assert got == pytest.approx((z @ v).tolist(), abs=1e-9)
    assert rows(pca.loadings(spark, model))[2] == ("f2", model.weights[0][2], model.weights[1][2])
    assert rows(pca.variance(spark, model))[1][2] == pytest.approx(sum(model.ratios))


def test_pca_agrees_with_ml(spark):
    from pyspark.ml.feature import PCA, VectorAssembler
    df, _, cols = features(spark, seed=4)
    model = pca.fit_pca(df, cols)
    z = pca.standardise(df, cols)
    vec = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="x").transform(z)
    fitted = PCA(k=2, inputCol="x", outputCol="y").fit(vec)
    assert fitted.explainedVariance.toArray().tolist() == pytest.approx(model.ratios)
    assert np.abs(fitted.pc.toArray().T) == pytest.approx(np.abs(np.array(model.weights)))


def test_pca_of_two_equal_features_and_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (4.0, 8.0, 7.0), (None, 1.0, 7.0)], ["a", "b", "c"])
    model = pca.fit_pca(df, ["a", "b"])
    assert model.n == 3 and model.ratios == pytest.approx([1.0, 0.0])
    assert model.weights[0] == pytest.approx([math.sqrt(0.5)] * 2)
    withc = pca.fit_pca(df, ["a", "b", "c"])
    assert withc.weights[0] == pytest.approx([math.sqrt(0.5)] * 2 + [0.0])
    assert {r.z_c for r in pca.standardise(df, ["c"]).collect()} == {0.0}
    with pytest.raises(ValueError):
        pca.fit_pca(df.filter("a > 99"), ["a", "b"])


def test_moments_and_correlations(spark):
    df, data, cols = features(spark, d=3)
    assert [r[1:] for r in rows(pca.feature_moments(df, cols))] == [
        (pytest.approx(m), pytest.approx(s)) for m, s in zip(data.mean(0), data.std(0))]
    corr = np.corrcoef(data.T)
    assert [r[2] for r in rows(pca.correlation_matrix(df, cols))] == pytest.approx(
        [corr[0, 1], corr[0, 2], corr[1, 2]])


def test_zone_separation(spark):
    scores = spark.createDataFrame(
        [("Residential", 0.0, 0.0), ("Residential", 2.0, 0.0), ("Industrial", 4.0, 4.0)], ["zone", "PC1", "PC2"])
    r = pca.zone_separation(scores).first()
    assert (r.res_pc1, r.ind_pc1, r.centroid_gap, r.pc1_difference) == (1.0, 4.0, 5.0, 3.0)
    assert rows(pca.zone_centroids(scores), "zone") == [("Industrial", 4.0, 4.0, 1), ("Residential", 1.0, 0.0, 2)]
    one_sided = pca.zone_separation(scores.filter("zone = 'Residential'")).first()
    assert one_sided.centroid_gap is None and one_sided.pc1_difference is None
    model = pca.PcaModel(["a"], [0.0], [1.0], [[1.0], [0.0]], [0.75, 0.25], 3)
    assert rows(pca.kpi_pca(scores, model)) == [(3, 1.0, 0.75, 0.25, 5.0)]


# --- exposure and reconcile -------------------------------------------------

def test_exposure(spark):
    df = spark.createDataFrame(
        [("1", 10.0), ("1", 20.0), ("2", 60.0), ("3", 5.0), ("3", NAN), ("4", 1.0)], "station_id string, value double")
    names = spark.createDataFrame(
        [("1", "MIDC Khutala, Pune"), ("2", "MIDC Khutala, Pune"), ("3", "Sector 11, Noida")],
        "station_id string, location_name string")
    means = exposure.station_means(df, names=names)
    density = spark.createDataFrame([("MIDC Khutala, Pune", 900)], "location_name string, pop_density int")
    got = exposure.exposure(means, density).select("short_name", "pm25_mean", "pop_density", "zone")
    assert rows(got, "short_name") == [
        ("MIDC Khutala", 30.0, 900, "Industrial"), ("Sector 11", 5.0, None, "Residential")]
    assert rows(exposure.exposure(means.limit(0), density)) == []
    carried = df.join(names, "station_id").drop("station_id")
    assert rows(exposure.station_means(carried), "location_name") == rows(means, "location_name")


def test_reconcile(spark):
    schema = "h int, value double"
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 4.0)], schema)
    b = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0), (2, 7.0)], schema)
    got = reconcile.reconcile(a, b, ["h"])
    assert rows(got, "h") == [
        (0, 1.0, 1.0, 0.0, "match"), (1, 2.0, 3.0, -1.0, "differ"),
        (2, None, 6.0, None, "only_b"), (3, 4.0, None, None, "only_a")]
    assert rows(reconcile.reconcile_summary(got).select("status", "n", "max_abs_diff"), "status") == [
        ("differ", 1, 1.0), ("match", 1, 0.0), ("only_a", 1, None), ("only_b", 1, None)]
    assert {r.status for r in reconcile.reconcile(a, b, ["h"], tolerance=1.0).collect()} == {
        "match", "only_a", "only_b"}


# --- timeline from ordered rows ---------------------------------------------

def test_timeline_from_order(spark):
    df = spark.createDataFrame([("a", 7), ("a", 3), ("b", 1)], "s string, o int")
    got = timeline.timeline_from_order(df, ["s"], ["o"], start="2024-12-31 23:00:00")
    assert rows(got.select("s", "o", "row_idx", "ts"), "s", "o") == [
        ("a", 3, 1, datetime(2024, 12, 31, 23)), ("a", 7, 2, datetime(2025, 1, 1, 0)),
        ("b", 1, 1, datetime(2024, 12, 31, 23))]


# --- random samples against numpy -------------------------------------------

def random_samples():
    rng = np.random.default_rng(11)
    kinds = [
        lambda n: rng.gamma(2, 40, n).round(1),
        lambda n: rng.integers(-3, 4, n).astype(float),
        lambda n: np.full(n, 7.0),
        lambda n: rng.normal(0, 1e6, n),
        lambda n: np.where(rng.random(n) < 0.3, np.nan, rng.exponential(90, n).round(2)),
    ]
    return {f"g{i}": kinds[i % 5](int(rng.integers(1, 80))) for i in range(40)}


def test_random_samples(spark):
    samples = random_samples()
    df = spark.createDataFrame(
        [(g, float(x)) for g, xs in samples.items() for x in xs], "g string, value double").repartition(7)
    stats = {r.g: r for r in tails.tail_stats(df, by=["g"]).collect()}
    curves = {}
    for r in tails.survival_curve(df, by=["g"]).collect():
        curves.setdefault(r.g, {})[r.x] = r.survival
    for g, xs in samples.items():
        pos = xs[xs > 0]
        if not len(pos):
            assert g not in stats and g not in curves
            continue
        r, centred = stats[g], pos - pos.mean()
        assert (r.n, r.count_ext) == (len(pos), int((pos > 200).sum()))
        assert r.p99 == pytest.approx(np.percentile(pos, 99))
        assert r.pct_ext == pytest.approx(100 * (pos > 200).mean())
        if np.ptp(pos) > 0:
            assert r.skewness == pytest.approx((centred**3).mean() / (centred**2).mean() ** 1.5, abs=1e-9)
        assert curves[g] == {
            x: pytest.approx(max(1e-6, 1 - (pos <= x).mean())) for x in np.unique(pos).tolist()}


def test_row_order_and_partitions_change_nothing(spark):
    df, _, cols = features(spark, n=200)
    base = pca.fit_pca(df, cols)
    for other in (df.orderBy(F.col("id").desc()).coalesce(1), df.repartition(9, "zone")):
        model = pca.fit_pca(other, cols)
        assert np.array(model.weights) == pytest.approx(np.array(base.weights), abs=1e-9)
        assert model.ratios == pytest.approx(base.ratios)
