"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table; its schema is taken from the file once per path."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles summed in another order differ in their last bits; compare them rounded."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def query(sql: str, name: str | None = None):
    """Register a query under its function name with its SQL."""

    def register(job: Callable[[SparkSession, str], DataFrame]):
        @wraps(job)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            result = job(spark, folder)
            # Plain timestamps, as in the tables, whatever zone the reader sits in.
            zoned = [f.name for f in result.schema if isinstance(f.dataType, T.TimestampType)]
            return result.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})

        key = name or job.__name__
        QUERIES[key] = run
        ORACLES[key] = sql
        return run

    return register
