"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which every executor has to see.

    There is no default: a folder that only one machine sees would lose rows on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written to, under this application's own folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/stationlake/{app}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where a table is read more than once and has to be the very same rows each
    time (partition numbers, fitted data), or where its exact size should decide
    the join: the size of the written files is what the broadcast threshold sees.
    The table outlives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
