from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions import text, time, values
from stationlake.functions.vocabulary import classify_zone, normalise_parameter, parameter_dim
from tests.conftest import rows


def one(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], [*given]) if given else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "mode, expected", [("null", None), ("other", "other"), ("keep", "co")]
)
def test_normalise_parameter(spark, mode, expected):
    df = spark.createDataFrame([("PM2.5",), ("o3",), ("relativehumidity",), ("CO",), (None,)], "p string")
    got = [r[0] for r in df.select(normalise_parameter(F.col("p"), mode)).collect()]
    assert got == ["pm25", "ozone", "humidity", expected, None]


def test_normalise_parameter_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        normalise_parameter(F.lit("x"), "drop")


def test_zone_rules(spark):
    df = spark.createDataFrame(
        [(0, "Talkatora District Industries Center"), (1, "Sector 11, India"), (2, "MIDC Khutala"),
         (3, "Anand Vihar"), (4, None)], "i int, n string")
    default, narrow, cased = [
        [r[0] for r in df.orderBy("i").select(classify_zone(F.col("n"), s)).collect()]
        for s in ("default", "narrow", "cased")
    ]
    assert default == ["Industrial", "Residential", "Industrial", "Residential", "Residential"]
    assert narrow == ["Industrial", "Residential", "Residential", "Residential", "Residential"]
    assert cased == ["Industrial", "Industrial", "Industrial", "Residential", "Residential"]


def test_parameter_dim(spark):
    dim = dict(rows(parameter_dim(spark)))
    assert len(dim) == 10 and dim[15] == "no2" and dim[32] == "ozone" and dim[134] == "humidity"


def test_paths(spark):
    p = "data/raw/station=17/pm2.5.csv"
    assert one(spark, text.station_of(F.lit(p))) == "17"
    assert one(spark, text.parameter_of(F.lit(p))) == "pm2.5"
    assert one(spark, text.parameter_of(F.lit("data\\raw\\o3.csv"))) == "o3"
    assert one(spark, text.station_of(F.lit("data/raw/Delhi_17/a.csv"))) == ""
    assert one(spark, text.decoded(F.lit("a%20b+c.csv"))) == "a b+c.csv"
    assert one(spark, text.decoded(F.lit("50%.csv"))) == "50%.csv"


def test_labels(spark):
    assert one(spark, text.short_label(F.lit("Anand Vihar, Delhi - DPCC"))) == "Anand Vihar"
    assert one(spark, text.safe_name(F.lit("a/b\\c:d"))) == "a_b_c_d"
    assert one(spark, text.truncated(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, text.file_prefix(F.lit("pm25_sensor_7.csv"))) == "pm25"


def test_values(spark):
    df = spark.createDataFrame(
        [(1, "10"), (2, ""), (3, "nan"), (4, "oops"), (5, " 2.5 ")], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(values.number_of(F.col("t"))).collect()]
    assert got == [10.0, None, None, None, 2.5]
    assert one(spark, values.clipped(F.lit(1.5), 0.0, 1.0)) == 1.0
    assert one(spark, values.clipped(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, values.is_positive(F.lit(float("nan")))) is False
    assert one(spark, values.utc_text(F.lit('{"utc": "2025-01-01T00:00:00Z"}'))) == "2025-01-01T00:00:00Z"
    assert one(spark, values.utc_text(F.lit("2025-01-01"))) == "2025-01-01"


def test_conform(spark):
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.DoubleType())])
    got = values.conform(spark.createDataFrame([(1, 2)], "a int, b int"), schema)
    assert got.schema.simpleString() == "struct<b:bigint,c:double>"
    assert rows(got) == [(2, None)]


def test_parse_ts_drops_what_it_cannot_read(spark):
    df = spark.createDataFrame([("2025-01-01 03:00:00",), ("oops",), (None,)], "t string")
    assert rows(time.parse_ts(df, "t").select("ts")) == [(datetime(2025, 1, 1, 3),)]


def test_time_of_position_beyond_an_int_of_hours(spark):
    far = one(spark, time.time_of_position(F.lit(3_000_000_000).cast("long"), step_seconds=1))
    assert far == datetime(2025, 1, 1) + timedelta(seconds=2_999_999_999)
    assert one(spark, time.time_of_position(F.lit(1))) == datetime(2025, 1, 1)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_align_year(spark, kind):
    df = spark.sql(
        f"SELECT CAST(t AS {kind}) AS ts FROM VALUES ('2024-02-28 05:00:00'), "
        "('2024-02-29 05:00:00'), ('2023-12-31 23:59:58.5') AS v(t)")
    got = time.align_year(df)
    assert got.schema["ts_aligned"].dataType == df.schema["ts"].dataType
    assert rows(got.select("ts_aligned"), "ts_aligned") == [
        (datetime(2025, 2, 28, 5),), (datetime(2025, 12, 31, 23, 59, 58),)]


def test_month_name(spark):
    assert one(spark, time.month_name(F.lit(9))) == "Sep"


def test_period_windows(spark):
    wins = one(spark, time.period_windows("2025-01-01", "2025-12-31", 30))
    assert len(wins) == 13
    assert wins[0][1:] == (datetime(2025, 1, 1), datetime(2025, 1, 31))
    assert wins[-1][1:] == (datetime(2025, 12, 27), datetime(2025, 12, 31))
    exact = one(spark, time.period_windows("2025-01-01", "2025-03-02", 30))
    assert len(exact) == 2
    for win, first, end in wins:
        for inside in (first, end - timedelta(seconds=1)):
            assert one(spark, time.window_index(F.lit(inside), "2025-01-01", 30)) == win
        assert one(spark, time.window_start(F.lit(win), "2025-01-01", 30)) == first
