"""Readings bucketed by station and day: what is grouped by them needs no shuffle.

Pivots, daily sums and everything built on them group by station and time. Rows are dealt once, when
written, to buckets by the hash of (station, day) and sorted there, one file a bucket; later jobs read
a bucket a task and group what they find. The day is part of the key so that a station with a third of
all readings is spread over all buckets. The number of buckets is part of the table: choose it so that a
bucket holds some hundred megabytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.vocabulary import FEATURES
from stationlake.operators.wide import station_pivot
from stationlake.streaming.daily import daily_sums

KEYS = ["station_id", "day"]


def write_colocated(readings: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Write readings with their ``day`` as the bucketed table ``table`` (at ``path``, else in the warehouse)."""
    dated = readings.withColumn("day", F.to_date("ts"))
    # Dealt by the hash and number of the buckets, so that each task writes one file.
    writer = dated.repartition(buckets, *KEYS).write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, *KEYS).sortBy(*KEYS, "ts").saveAsTable(table)


def read_colocated(spark: SparkSession, table: str) -> DataFrame:
    """The readings with their ``day``; jobs keep the buckets as long as they group by ``KEYS`` and more."""
    return spark.table(table)


def features(colocated: DataFrame, wanted: Sequence[str] = FEATURES) -> DataFrame:
    """Feature rows by station and time, as ``wide.station_pivot``, without a shuffle."""
    return station_pivot(colocated, [*KEYS, "ts"], features=wanted).drop("day")


def sums(colocated: DataFrame, **more) -> DataFrame:
    """Daily sums (``streaming.daily``) without a shuffle."""
    return daily_sums(colocated, **more)
