"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Hours are counted on the UTC axis, so a station never has a 23 or 25 hour day.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot station's shuffle partition when a dimension is too big to broadcast.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No job hints a broadcast: Spark broadcasts a side only when its measured size is below this.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    # Raw folders hold many small files; pack them into fewer tasks.
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.files.openCostInBytes": "1m",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session somebody else built."""
    for key, setting in SETTINGS.items():
        spark.conf.set(key, setting)
    return spark


def get_session(app: str = "stationlake", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``conf`` adds settings such as ``spark.checkpoint.dir``."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, setting in {**SETTINGS, **conf}.items():
        builder = builder.config(key, setting)
    return builder.getOrCreate()
