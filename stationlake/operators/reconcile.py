"""Comparing two sources of the same series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions.values import clean


def reconcile(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 0.0
) -> DataFrame:
    """Per key: value of each source, difference and status.

    Status is match, differ, only_a or only_b (a source that has no value there counts
    as absent). Keys repeated within a source are averaged. The sources are stacked and
    aggregated in one shuffle, which gives what a full outer join would, without a join
    in which repeated keys multiply.
    """
    side = lambda df, tag: df.select(
        *keys, clean(F.col(value)).alias("_v"), F.lit(tag).alias("_side")
    )
    both = side(a, "a").unionByName(side(b, "b"))
    merged = both.groupBy(*keys).agg(
        F.avg(F.when(F.col("_side") == "a", F.col("_v"))).alias("a"),
        F.avg(F.when(F.col("_side") == "b", F.col("_v"))).alias("b"),
    ).filter(F.col("a").isNotNull() | F.col("b").isNotNull())
    status = (
        F.when(F.col("b").isNull(), "only_a")
        .when(F.col("a").isNull(), "only_b")
        .when(F.abs(F.col("a") - F.col("b")) <= tolerance, "match")
        .otherwise("differ")
    )
    return merged.select(*keys, "a", "b", (F.col("a") - F.col("b")).alias("diff"), status.alias("status"))


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Per status: keys, mean and largest absolute difference."""
    gap = F.abs(F.col("diff"))
    return reconciled.groupBy("status").agg(
        F.count("*").alias("n"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff")
    )
