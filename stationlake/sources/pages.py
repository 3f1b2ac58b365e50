"""Landed measurement pages (JSON lines, one page of results per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions import time, values


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).json(path)


def land_measurements(pages: DataFrame) -> DataFrame:
    """One canonical reading per result; the time is the UTC start of the period.

    The start may be an object with ``utc`` or plain text.
    """
    flat = pages.select(
        F.col("location_id").cast("string").alias("station_id"),
        "location_name",
        "parameter",
        "units",
        F.explode("results").alias("r"),
    ).select(
        "station_id", "location_name", "parameter", "units",
        values.clean(F.col("r.value")).alias("value"),
        values.utc_text(F.col("r.period.datetimeFrom")).alias("started"),
    )
    return values.conform(time.parse_ts(flat, "started"), schemas.READINGS)
