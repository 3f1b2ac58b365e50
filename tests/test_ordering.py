from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationlake.operators import ordering, tails
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; station a holds half of them, and one value half of its rows."""
    return (
        spark.range(3000)
        .select(
            F.col("id"),
            F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 7 == 0, None)
            .otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("station"),
            F.when(F.col("id") % 4 == 0, F.lit(5.0))
            .otherwise(F.round(F.rand(3) * 100, 1)).alias("v"),
        )
        .coalesce(1)
    )


def test_numbered_equals_row_number(spark, skewed):
    got = ordering.numbered(skewed, [F.col("id").desc()], ["station"], into="n", total="size")
    w = Window.partitionBy("station")
    want = skewed.select(
        "id", F.row_number().over(w.orderBy(F.col("id").desc())).cast("long").alias("n"),
        F.count("*").over(w).alias("size"))
    assert rows(got.select("id", "n", "size"), "id") == rows(want, "id")


def test_numbered_without_groups(spark, skewed):
    got = ordering.numbered(skewed, ["id"], into="n")
    assert got.filter("n <> id + 1").count() == 0 and got.count() == 3000


def test_running_counts_equal_cume_dist(spark, skewed):
    got = ordering.running_counts(skewed, "v", ["station"])
    w = Window.partitionBy("station").orderBy("v")
    want = skewed.select("station", "v", F.cume_dist().over(w).alias("c")).distinct()
    got = got.select("station", "v", (F.col("upto") / F.col("total")).alias("c"))
    assert rows(got, "station", "v") == rows(want, "station", "v")


def test_one_group_equals_no_group(spark, skewed):
    one = ordering.running_counts(skewed.withColumn("g", F.lit(1)), "v", ["g"]).drop("g")
    assert rows(one, "v") == rows(ordering.running_counts(skewed, "v"), "v")


@pytest.mark.parametrize("partitions", ["1", "3", "17"])
def test_quantiles_equal_numpy(spark, skewed, conf, partitions):
    """Groups of any size are ranked in the same way, whatever the number of tasks."""
    conf("spark.sql.shuffle.partitions", partitions)
    ps = {"p0": 0.0, "p25": 0.25, "p5": 0.5, "p99": 0.99, "p100": 1.0}
    got = ordering.exact_quantiles(skewed, "v", ps, ["station"]).collect()
    data = skewed.toPandas()
    assert len(got) == data.station.nunique(dropna=False)
    for r in got:
        own = data[data.station == r.station] if r.station else data[data.station.isna()]
        assert [r[k] for k in ps] == pytest.approx([np.percentile(own.v, 100 * p) for p in ps.values()])


def test_quantile_of_few_values(spark):
    one = spark.createDataFrame([(3.0,)], "v double")
    assert rows(ordering.exact_quantiles(one, "v", {"q": 0.99})) == [(3.0,)]
    assert rows(ordering.exact_quantiles(one.filter("v > 9"), "v", {"q": 0.99})) == [(None,)]
    hundred = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert rows(ordering.exact_quantiles(hundred, "v", {"q": 0.99}))[0][0] == pytest.approx(99.01)


def test_null_order_keys_are_kept(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    got = ordering.numbered(df, ["id"], ["g"], into="n")
    assert rows(got.select("id", "n"), "id") == [(1, 1), (2, 2), (3, 1)]


def test_top_and_busiest(spark, skewed):
    assert rows(ordering.busiest(skewed, "station")) == [("a", 1500)]
    assert [r.id for r in ordering.top(skewed, [F.col("id").desc()], 3).collect()] == [2999, 2998, 2997]


def test_running_sums(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 7), ("y", 1, 1)], "g string, o int, w long")
    got = ordering.running_sums(df, "w", ["o"], ["g"])
    assert rows(got.select("g", "o", "upto", "total"), "g", "o") == [
        ("x", 1, 5, 12), ("x", 2, 12, 12), ("y", 1, 1, 1)]


@pytest.mark.parametrize("accuracy, margin", [(10000, 2.0), (50, 2.0), (5, 0.0), (2, 0.0)])
def test_bracketed_quantiles_stay_exact_when_the_sketch_misses(spark, skewed, accuracy, margin):
    ps = {"p0": 0.0, "p25": 0.25, "p26": 0.26, "p99": 0.99, "p100": 1.0}
    got = ordering.bracketed_quantiles(skewed, "v", ps, accuracy, margin)
    data = skewed.toPandas().v
    assert list(got.first()) == pytest.approx([np.percentile(data, 100 * p) for p in ps.values()])


def test_a_hot_station_is_spread_over_partitions(spark, conf, monkeypatch):
    """No task holds more than its share of rows though one station holds a third of them."""
    conf("spark.sql.shuffle.partitions", "12")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    keep = ordering.staged

    def watched(df, label):
        table = keep(df, label)
        if "_part" in table.columns and label in ("numbered", "sums"):
            seen.append(table)
        return table

    monkeypatch.setattr(ordering, "staged", watched)
    df = spark.range(12000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("station"),
        (F.col("id") * 7919 % 10007).cast("double").alias("v"))
    ordering.numbered(df, ["id"], ["station"])
    ordering.running_counts(df, "v", ["station"])
    for table in seen:
        sizes = [r["count"] for r in table.groupBy("_part").count().collect()]
        hot = table.filter("station = 7").select("_part").distinct().count()
        assert max(sizes) < 3 * table.count() / 12 and hot >= 3
    assert len(seen) == 2


def test_quantiles_ignore_nan_and_null(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 3.0, float("nan"), None)], "g string, v double")
    assert rows(ordering.exact_quantiles(df, "v", {"q": 0.5})) == [(2.0,)]
    assert rows(ordering.exact_quantiles(df, "v", {"q": 0.5}, ["g"])) == [("a", 2.0)]


def test_running_sums_shuffle_the_rows_once(spark, skewed, conf):
    conf("spark.sql.adaptive.enabled", "false")
    distinct = skewed.groupBy("station", "v").agg(F.count("*").alias("cnt"))
    ranged = distinct.repartitionByRange("station", "v").sortWithinPartitions("station", "v")
    plan = ordering._summed_in_order(ranged, "cnt")._jdf.queryExecution().executedPlan().toString()
    # The rows are dealt by range once and added up where they are.
    assert plan.count("rangepartitioning") == 1 and "Window" not in plan


def test_a_hot_station_is_summed_by_many_tasks(spark, skewed, conf):
    conf("spark.sql.shuffle.partitions", "8")
    conf("spark.sql.adaptive.enabled", "false")
    distinct = skewed.groupBy("station", "v").agg(F.count("*").alias("cnt"))
    ranged = distinct.repartitionByRange("station", "v").sortWithinPartitions("station", "v")
    per_task = [r["count"] for r in ordering._summed_in_order(ranged, "cnt").groupBy("_part").count().collect()]
    assert len(per_task) == 8 and max(per_task) < 2 * sum(per_task) / 8


def counted_rows(spark, df):
    """The table with a count of the rows that tasks read of it."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), read


def test_group_quantiles_rank_only_what_is_inside_the_brackets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [("hot", float(x)) for x in rng.gamma(2, 40, 30000)] + [(f"s{k % 40}", float(x)) for k, x in enumerate(rng.normal(size=4000))]
    data += [(None, float(x)) for x in rng.normal(size=500)] + [("same", 7.0)] * 3000 + [("few", 1.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    ps = {"q25": 0.25, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q1": 1.0}
    ranked, sums = [], ordering.running_sums

    def spy(counts, *more):
        ranked.append(counts.count())
        return sums(counts, *more)

    monkeypatch.setattr(ordering, "running_sums", spy)
    got = {r["g"]: r for r in ordering.exact_quantiles(df, "v", ps, ["g"]).collect()}
    assert len(ranked) == 1 and ranked[0] < 6500 < 34000  # all but the hot group have exact or small brackets
    for g in {g for g, v in data if v is not None}:
        own = [v for h, v in data if h == g and v is not None]
        for name, p in ps.items():
            assert got[g][name] == pytest.approx(np.percentile(own, 100 * p), rel=1e-12)
    assert "none" not in got


@pytest.mark.parametrize("accuracy,margin", [(3, 0.0), (10, 0.1), (50, 1.0)])
def test_group_quantiles_stay_exact_when_the_sketch_misses(spark, accuracy, margin):
    rng = np.random.default_rng(6)
    data = [(f"s{k % 3}", float(round(x))) for k, x in enumerate(rng.gamma(2, 40, 3000))]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    ps = {"a": 0.5, "b": 0.51, "c": 0.99}
    for r in ordering.bracketed_by_group(df, "v", ps, ["g"], accuracy, margin).collect():
        own = [v for g, v in data if g == r["g"]]
        assert [r[n] for n in ps] == pytest.approx([np.percentile(own, 100 * p) for p in ps.values()])


def test_summaries_read_the_data_twice(spark):
    rng = np.random.default_rng(7)
    values = [float(x) for x in rng.gamma(2, 80, 5000)] + [-3.0, 0.0, None, float("nan")] * 50
    df = spark.createDataFrame([(x,) for x in values], "value double").repartition(3)
    good = np.array([x for x in values if x is not None and x > 0])
    q = np.percentile(good, 99)

    data, read = counted_rows(spark, df)
    stats = tails.tail_stats(data).first()
    assert read.value == 2 * len(values)
    assert (stats.n, stats.count_ext) == (len(good), (good > 200).sum()) and stats.p99 == pytest.approx(q, rel=1e-12)

    data, read = counted_rows(spark, df)
    got = tails.exceedance_at(data).first()
    assert read.value == 2 * len(values)
    assert got.q == pytest.approx(q, rel=1e-12) and got.n_all == len(values)
    assert got.exceedance == (good > got.q).sum() / len(values)

    data, read = counted_rows(spark, df)
    assert tails.histogram(data, bins="fd").agg({"n": "sum"}).first()[0] == len(values) - 100
    assert read.value == 3 * len(values)  # the bins need the quartiles

    for empty in (df.limit(0), df.where("value < 0")):
        got, n = tails.exceedance_at(empty).first(), empty.count()
        assert got.q is None and got.n_all == n and got.exceedance == (0.0 if n else None)
        assert tails.tail_stats(empty).first().n == 0 and tails.histogram(empty.limit(0), bins="fd").count() == 0
