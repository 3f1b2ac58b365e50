"""Share of readings above a limit, by station and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions import text
from stationlake.functions.values import clean, exceeds
from stationlake.functions.vocabulary import MONTHS, VIOLATION_LIMIT
from stationlake.operators.ordering import numbered


def _counted(df: DataFrame, value: str, null_as_safe: bool) -> DataFrame:
    """Readings that count. A missing reading counts as safe only if asked for."""
    return df if null_as_safe else df.filter(clean(F.col(value)).isNotNull())


def violation_rate(
    df: DataFrame,
    keys: Sequence[str | Column],
    value: str = "value",
    limit: float = VIOLATION_LIMIT,
    null_as_safe: bool = False,
) -> DataFrame:
    """Mean violation flag and number of readings per key."""
    return _counted(df, value, null_as_safe).groupBy(*keys).agg(
        F.avg(exceeds(F.col(value), limit)).alias("violation_rate"), F.count("*").alias("n")
    )


def violation_heatmap(
    df: DataFrame,
    station: str = "station_id",
    ts: str = "ts",
    value: str = "value",
    names: DataFrame | None = None,
    name: str = "location_name",
    separator: str = ",",
    limit: float = VIOLATION_LIMIT,
    null_as_safe: bool = False,
    rank: bool = False,
) -> DataFrame:
    """Label by month matrix of violation rates with ``row_mean``, worst label first.

    Readings are reduced to one row per (station, month) before names are joined and
    labels (text before the separator) merged, so neither the join nor a hot station
    ever sees single readings. ``row_mean`` is the mean of the months present. A month
    without readings is a NULL column. Without ``names`` the station itself is the name.
    ``rank`` numbers the rows by a ranged sort.
    """
    monthly = _counted(df, value, null_as_safe).groupBy(
        F.col(station), F.month(ts).alias("_month")
    ).agg(F.sum(exceeds(F.col(value), limit)).alias("_hits"), F.count("*").alias("_n"))
    if names is not None:
        monthly = monthly.join(names, station)
    full_name = F.col(name if names is not None else station)
    labelled = monthly.withColumn("label", text.short_label(full_name, separator))

    wide = labelled.groupBy("label").agg(*[
        F.expr(f"sum(if(_month = {m}, _hits, null)) / sum(if(_month = {m}, _n, null))").alias(name)
        for m, name in enumerate(MONTHS, 1)
    ])
    total = " + ".join(f"coalesce({m}, 0D)" for m in MONTHS)
    present = " + ".join(f"if({m} is null, 0, 1)" for m in MONTHS)
    matrix = wide.withColumn("row_mean", F.expr(f"try_divide({total}, {present})"))
    worst_first = [F.col("row_mean").desc(), F.col("label")]
    if rank:
        return numbered(matrix, worst_first, into="rank").orderBy("rank")
    return matrix.orderBy(*worst_first)
