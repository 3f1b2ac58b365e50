"""Landing only what is new, with the file stream source and its checkpoint.

Each call processes the files that arrived since the last one and stops. Files are
remembered in the checkpoint, so a restart neither repeats nor skips one. Readings are committed
batch by batch to the snapshots of the readings table, each batch once, and small folders are
merged as they pile up.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions import values
from stationlake.functions.vocabulary import TIMELINE_START, normalise_parameter
from stationlake.operators.timeline import rebuild_timeline
from stationlake.sources import long, snapshots
from stationlake.sources.readings import compact_readings
from stationlake.sources.shared import staged
from stationlake.streaming import daily


def land_long(
    spark: SparkSession,
    raw: str,
    out: str,
    checkpoint: str,
    rejects: str | None = None,
    max_files: int | None = None,
    fan: int = snapshots.FAN,
    daily_out: str | None = None,
) -> int:
    """Land new long CSV files under ``raw`` into the readings table ``out``.

    Every micro-batch (which holds whole files) is parsed once and split into readings and
    rejects, which go to ``rejects`` when that folder is named. Readings are clustered by
    parameter and station, so a batch writes few files. A batch that runs again after a failure
    replaces what it left, or adds nothing if it was committed. ``max_files`` bounds the files of
    one batch, for the first landing of a large folder; ``fan`` is the number of small folders that are
    merged (0: none). ``daily_out`` names the table of daily sums that is kept up with the readings
    (``streaming.daily``). Returns the lines landed or rejected.
    """
    landed: list[int] = []

    def land(batch: DataFrame, batch_id: int) -> None:
        good, bad = long.split_parsed(staged(long.parsed_lines(batch), "landing-parsed"))
        readings = long.to_readings(good).withColumn(
            "parameter", normalise_parameter(F.col("parameter"), "keep")
        )
        clustered = readings.repartitionByRange("parameter", "station_id", "ts")
        source = source_of(spark, f"{checkpoint}/readings")
        landed.append(_land(clustered, out, source, batch_id, fan))
        if daily_out is not None:
            daily.land_daily(readings, daily_out, source, batch_id, fan)
        counted = bad.agg(F.count("*")).first()[0] if rejects is None else _write_batch(bad, rejects, batch_id)
        landed.append(counted)

    query = (
        long.stream_lines(spark, raw, max_files).writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{checkpoint}/readings")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(landed)


def source_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream of a checkpoint; one that is set up anew gets another, and counts from 0."""
    return json.loads(snapshots.text_of(spark, f"{checkpoint}/metadata"))["id"]


def _land(rows: DataFrame, out: str, source: str, batch_id: int, fan: int) -> int:
    """Commit the rows of a micro-batch to the readings table, once, and count them."""
    spark, counted = rows.sparkSession, Observation()
    snapshots.adopted(spark, out, schemas.READINGS, "parameter")
    observed = rows.observe(counted, F.count("*").alias("n"))
    if not snapshots.land(spark, out, observed, "parameter", source, batch_id):
        return 0
    if fan:
        compact_readings(spark, out, fan)
    return counted.get["n"]


def _write_batch(rows: DataFrame, out: str, batch_id: int) -> int:
    """Write the rows of a micro-batch in place of an earlier try, and count them."""
    counted = Observation()
    rows.withColumn("batch", F.lit(batch_id)).observe(counted, F.count("*").alias("n")).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
    return counted.get["n"]


def land_bare(
    spark: SparkSession,
    raw: str,
    out: str,
    checkpoint: str,
    start: str = TIMELINE_START,
    step_seconds: int = 3600,
    file_filter: str = "*.csv",
    max_files: int | None = None,
    fan: int = snapshots.FAN,
) -> int:
    """Land new bare series files into ``out``, rebuilding their timeline.

    Line numbers need a batch, so each micro-batch (which always holds whole files) is
    numbered on its own. A batch is committed as in ``land_long``. Returns the readings landed
    by this call.
    """
    reader = spark.readStream.schema("line string, station string")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = (
        reader.option("pathGlobFilter", file_filter)
        .text(raw)
        .select(
            F.col("station").alias("station_id"),
            "line",
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )
    landed: list[int] = []

    def land(batch: DataFrame, batch_id: int) -> None:
        ids = batch.withColumn("line_id", F.monotonically_increasing_id())
        parsed = ids.select(
            "station_id", "source_file", "block_start", "line_id",
            values.number_of(F.col("line")).alias("value"),
        )
        timeline = rebuild_timeline(parsed, start, step_seconds).withColumn(
            "parameter", normalise_parameter(F.col("parameter"), "keep")
        )
        readings = values.conform(timeline, schemas.READINGS)
        landed.append(_land(readings, out, source_of(spark, checkpoint), batch_id, fan))

    query = (
        lines.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(landed)
