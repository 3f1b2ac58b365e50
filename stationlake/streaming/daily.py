"""Sums by parameter, station and day that are kept up with each landed batch.

Violation rates, station means and coverage are sums, counts and sets of hours, so they need not read all
readings again: a batch adds its own sums, a few bytes a station and day instead of 24 readings
and more. Rows of one key add up (hours are the bits of a number, united by OR), so a batch is
only appended, merging folders reduces them, and what the batches' borders are does not matter. The table is a
snapshot table of its own: each batch is counted once, and a series that is replaced in the readings
is replaced here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions.values import clean, exceeds
from stationlake.functions.vocabulary import VIOLATION_LIMIT, WINDOW_DAYS
from stationlake.operators.completeness import spread_windows
from stationlake.sources import snapshots

KEYS = ["station_id", "location_name", "parameter", "day"]
_PARTITION, _ORDER = "parameter", ["station_id", "day"]


def daily_sums(readings: DataFrame, limit: float = VIOLATION_LIMIT) -> DataFrame:
    """Readings reduced to one row a key: rows, valid values, their sum, those above the limit, hours seen.

    A column ``day`` that the readings carry is taken as it is: buckets by it spare the shuffle.
    """
    day = F.col("day") if "day" in readings.columns else F.to_date("ts").alias("day")
    value = clean(F.col("value"))
    return readings.groupBy("station_id", "location_name", "parameter", day).agg(
        F.count("*").alias("n_rows"), F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.sum(exceeds(F.col("value"), limit)).cast("long").alias("hits"), F.bit_or(F.expr("shiftleft(1, hour(ts))")).alias("hours"),
    ).select(*schemas.DAILY.names)


def added(rows: DataFrame) -> DataFrame:
    """Daily sums with one row a key."""
    return rows.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n", "total", "hits")], F.bit_or("hours").alias("hours")
    ).select(*schemas.DAILY.names)


def land_daily(
    readings: DataFrame, path: str, source: str, number: int, fan: int = snapshots.FAN, limit: float = VIOLATION_LIMIT
) -> bool:
    """Add the sums of a numbered batch of readings, once; False if it was added before."""
    spark = readings.sparkSession
    done = snapshots.land(spark, path, daily_sums(readings, limit), _PARTITION, source, number)
    if done and fan:
        snapshots.compact(spark, path, schemas.DAILY, _PARTITION, _ORDER, fan, added)
    return done


def replace_daily(readings: DataFrame, path: str, limit: float = VIOLATION_LIMIT) -> None:
    """Replace the sums of the series that ``readings`` holds whole, as ``write_readings`` does."""
    snapshots.write(daily_sums(readings, limit), path, schemas.DAILY, _PARTITION, _ORDER, ["station_id"])


def read_daily(spark: SparkSession, path: str, parameters: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
    """Daily sums, one row a key, of the wanted parameters (folders pruned)."""
    held = snapshots.snapshot(spark, path, version) or snapshots.Snapshot()
    return added(snapshots.read_entries(spark, path, schemas.DAILY, held.of(parameters)))


def violation_rates(daily: DataFrame, keys: Sequence[str | Column], null_as_safe: bool = False) -> DataFrame:
    """As ``violations.violation_rate``, for keys of the daily sums such as ``month(day)``."""
    n = "n_rows" if null_as_safe else "n"
    sums = daily.groupBy(*keys).agg(F.sum("hits").alias("_hits"), F.sum(n).alias("n"))
    names = [c for c in sums.columns if c not in ("_hits", "n")]
    return sums.where("n > 0").select(*names, F.try_divide(F.col("_hits"), F.col("n")).alias("violation_rate"), "n")


def means(daily: DataFrame, keys: Sequence[str] = ("location_name",), into: str = "pm25_mean") -> DataFrame:
    """As ``exposure.station_means``."""
    return daily.groupBy(*keys).agg(F.try_divide(F.sum("total"), F.sum("n")).alias(into))


def covered(
    daily: DataFrame, start: str, end: str, keys: Sequence[str] = ("station_id",), window_days: int = WINDOW_DAYS
) -> DataFrame:
    """As ``completeness.coverage``, for a period of whole days (UTC): hours are the bits of each day."""
    if any(len(t) > 10 and t[11:].strip("0:.") for t in (start, end)):
        raise ValueError("the daily sums know whole days")
    first, last = F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")
    days = daily.groupBy(*keys, "day").agg(F.bit_or("hours").alias("hours"))
    inside = (F.col("day") >= first) & (F.col("day") < last)
    win = F.when(inside, F.floor(F.datediff("day", first) / window_days)).cast("int")
    per_window = days.groupBy(*keys, win.alias("_win")).agg(F.sum(F.bit_count("hours")).cast("long").alias("_n"))
    return spread_windows(per_window, start, end, keys, window_days)


#: Logarithm of the sketch's size: a relative error of about 0.4 percent, 50 kB at most a parameter and day.
SKETCH_BITS = 16


def station_sketches(readings: DataFrame) -> DataFrame:
    """Per parameter and day the valid readings, and a sketch of the stations that they come from."""
    valid = readings.where(clean(F.col("value")).isNotNull() & F.col("station_id").isNotNull())
    return valid.groupBy("parameter", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("station_id", SKETCH_BITS).alias("stations")
    ).select(*schemas.STATION_SKETCHES.names)


def united(rows: DataFrame) -> DataFrame:
    """Sketches with one row a parameter and day."""
    return rows.groupBy("parameter", "day").agg(
        F.sum("n").alias("n"), F.hll_union_agg("stations").alias("stations")
    ).select(*schemas.STATION_SKETCHES.names)


def land_sketches(readings: DataFrame, path: str, source: str, number: int, fan: int = snapshots.FAN) -> bool:
    """Add the sketches of a numbered batch of readings, once; False if it was added before."""
    spark = readings.sparkSession
    done = snapshots.land(spark, path, station_sketches(readings), _PARTITION, source, number)
    if done and fan:
        snapshots.compact(spark, path, schemas.STATION_SKETCHES, _PARTITION, ["day"], fan, united)
    return done


def distinct_stations(
    spark: SparkSession, path: str, keys: Sequence[str | Column] = ("parameter",), parameters: Sequence[str] | None = None
) -> DataFrame:
    """Readings and about how many distinct stations gave them, for keys such as the parameter or ``month(day)``.

    Sketches of days are united, so any span of days costs one small row a day and no reading; an
    exact count over the readings (``wide.table_size``) stays the default elsewhere.
    """
    held = snapshots.snapshot(spark, path) or snapshots.Snapshot()
    rows = snapshots.read_entries(spark, path, schemas.STATION_SKETCHES, held.of(parameters))
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("stations")).alias("n_stations")
    )
