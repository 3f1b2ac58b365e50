"""The canonical readings table: parquet, one folder per parameter, under a manifest of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.sources import snapshots
from stationlake.sources.shared import staged

_PARTITION = "parameter"
_ORDER = ["station_id", "ts"]


def write_readings(readings: DataFrame, path: str, mode: str = "replace") -> None:
    """Write readings by parameter, clustered by station and time, as the next version of the table.

    Rows are ranged on (parameter, station, time): a hot station is spread over
    several files, and the row-group statistics let a station or time filter skip the
    rest. Stations get no folder of their own, which would mean one small file each.

    ``replace`` (the default) replaces the series, that is pairs of station and parameter,
    present in ``readings`` and keeps all others; ``overwrite`` replaces whole parameters;
    ``append`` adds. Only folders of parameters present are read and written again. A write that
    fails anywhere leaves the table as it was; if another writer changed the same parameters
    meanwhile, ``snapshots.Conflict`` is raised and nothing is lost.
    """
    snapshots.write(readings, path, schemas.READINGS, _PARTITION, _ORDER, ["station_id"], mode)


def compact_readings(spark: SparkSession, path: str, fan: int = snapshots.FAN) -> int:
    """Merge the small folders of each parameter into sorted files; returns the rounds of merging."""
    return snapshots.compact(spark, path, schemas.READINGS, _PARTITION, _ORDER, fan)


def read_readings(
    spark: SparkSession,
    path: str,
    parameters: Sequence[str] | None = None,
    stations: Sequence[str | int] | None = None,
    version: int | None = None,
) -> DataFrame:
    """Readings of the wanted parameters (folders pruned) and stations (pushed to the scan).

    The last committed version, or the one asked for; a folder without a manifest is read as it lies.
    """
    held = snapshots.snapshot(spark, path, version)
    if held is None:
        table = spark.read.schema(schemas.READINGS).parquet(path)
    else:
        table = snapshots.read_entries(spark, path, schemas.READINGS, held.of(parameters))
    if parameters is not None:
        table = table.filter(F.col(_PARTITION).isin(list(parameters)))
    if stations is not None:
        table = table.filter(F.col("station_id").isin([str(s) for s in stations]))
    return table


def attach_location(
    readings: DataFrame, names: DataFrame, key: str = "station_id"
) -> DataFrame:
    """Inner join with the (station_id, location_name) table.

    Carries no broadcast hint: Spark broadcasts the names when their size is below the
    threshold and otherwise joins by shuffle, splitting a hot station (skew join). Stage
    names that come from a join or a large file: Spark guesses a join's size as the product
    of its sides, and a guess too high would shuffle the readings for nothing.
    """
    own = readings.drop("location_name") if "location_name" in readings.columns else readings
    return own.join(names, key)


def new_only(new: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys have not been landed yet.

    The landed keys are staged, so that a short list is broadcast and ``new`` stays in place.
    """
    known = staged(landed.select(*keys).distinct(), "landed_keys")
    return new.join(known, list(keys), "left_anti")
