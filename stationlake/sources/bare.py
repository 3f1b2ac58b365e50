"""Bare series files: ``station={id}/{parameter}.csv``, no header, one value per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions import text, values


def read_bare(
    spark: SparkSession,
    root: str,
    stations: Sequence[str | int] | None = None,
    file_filter: str = "*.csv",
) -> DataFrame:
    """One row per line, blank lines included, with where the line came from.

    ``line_id`` grows by one from line to line within a split (``source_file``,
    ``block_start``); ``operators.timeline.line_numbers`` turns it into line numbers.
    The text reader is used because the CSV reader drops blank lines, which would
    shift every later hour. ``stations`` prunes folders and ``file_filter`` prunes
    files before anything is read; a filter put on the result prunes nothing, since
    Spark must not move it below ``line_id``.
    """
    lines = (
        spark.read.schema("line string, station string")
        .option("pathGlobFilter", file_filter)
        .text(root)
    )
    if stations is not None:
        lines = lines.filter(F.col("station").isin([str(s) for s in stations]))
    return _with_origin(lines.withColumnRenamed("station", "station_id"))


def read_lines(spark: SparkSession, path: str, file_filter: str = "*") -> DataFrame:
    """As ``read_bare`` for a folder without station sub-folders; ids come from the path."""
    lines = spark.read.schema("line string").option("pathGlobFilter", file_filter).text(path)
    origin = _with_origin(lines)
    return origin.withColumn("station_id", text.station_of("source_file"))


def _with_origin(lines: DataFrame) -> DataFrame:
    with_ids = lines.select(
        *[c for c in lines.columns if c != "line"],
        values.number_of(F.col("line")).alias("value"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    return with_ids.withColumn("parameter", text.parameter_of(text.decoded(F.col("source_file"))))
