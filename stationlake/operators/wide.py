"""Station-hour feature rows and their completeness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.values import clean
from stationlake.functions.vocabulary import FEATURES


def station_pivot(
    df: DataFrame,
    keys: Sequence[str | Column],
    parameter: str = "parameter",
    value: str = "value",
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Mean value of each wanted parameter per key, one column per parameter.

    Readings of other parameters are filtered out before the one shuffle; a parameter
    nobody reported becomes a NULL column.
    """
    wanted = df.filter(F.col(parameter).isin(list(features)))
    return wanted.groupBy(*keys).agg(*[
        F.avg(F.when(F.col(parameter) == f, clean(F.col(value)))).alias(f) for f in features
    ])


def complete_cases(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Rows that have every one of the columns."""
    return df.dropna(how="any", subset=list(columns))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls) from one pass over the rows."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns
    ])
    return counts.select(F.inline(pairs))


def completeness_counts(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """One row: rows before and after the complete-case filter, and rows removed."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    counts = df.agg(F.count("*").alias("rows_before"), F.count_if(whole).alias("rows_after"))
    return counts.withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def table_size(df: DataFrame, station: str, approx: bool = False) -> DataFrame:
    """One row: rows and distinct stations (``approx`` counts the stations by sketch)."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(F.count("*").alias("n_rows"), distinct(F.col(station)).alias("n_stations"))
