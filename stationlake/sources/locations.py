"""Location metadata with nested sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake import schemas


def read_locations(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Read the metadata file, one row per location with its sensors.

    ``multiline=True`` reads one JSON array per file; ``False`` reads JSON lines,
    which Spark can split for very large metadata.
    """
    return spark.read.option("multiLine", multiline).schema(schemas.LOCATION).json(path)


def station_names(locations: DataFrame) -> DataFrame:
    """(station_id as text, location_name)."""
    return locations.select(
        F.col("id").cast("string").alias("station_id"), F.col("name").alias("location_name")
    )


def sensor_counts(locations: DataFrame) -> DataFrame:
    """Number of sensors of each location (0 when the list is missing)."""
    return locations.select(
        "id", "name", F.coalesce(F.array_size("sensors"), F.lit(0)).alias("n_sensors")
    )


def explode_sensors(locations: DataFrame) -> DataFrame:
    """One row per sensor, with its place in the location's list."""
    return locations.select(
        F.col("id").alias("location_id"), "name", F.posexplode("sensors").alias("pos", "s")
    ).select(
        "location_id",
        "name",
        "pos",
        F.col("s.id").alias("sensor_id"),
        F.col("s.parameter.id").alias("param_id"),
        F.col("s.parameter.name").alias("param_name"),
        F.col("s.parameter.units").alias("units"),
    )


def write_locations(locations: DataFrame, path: str) -> None:
    """Write metadata as JSON lines (read back with ``multiline=False``)."""
    locations.write.json(path)
