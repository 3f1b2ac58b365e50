"""Tail statistics: percentiles, skewness, survival curve, exceedance, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions import text
from stationlake.functions.values import clean, clipped, is_positive
from stationlake.functions.vocabulary import (
    EXTREME_LIMIT,
    HISTOGRAM_BINS,
    SURVIVAL_FLOOR,
    TAIL_QUANTILE,
)
from stationlake.operators.ordering import (
    bracket_edges,
    busiest,
    exact_quantiles,
    quantiles_between,
    quantiles_of,
    running_counts,
)
from stationlake.sources.joins import match_keys


def positives(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a number above 0."""
    return df.filter(is_positive(F.col(value)))


def tail_ranks(df: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Running counts of the positive values.

    The statistics, curve and exceedance below all accept it as ``ranks``, so that one
    ranged sort serves them all.
    """
    return running_counts(positives(df, value), value, by)


def _tail_quantile(
    df: DataFrame, value: str, ps: dict[str, float], by: Sequence[str], ranks: DataFrame | None
) -> DataFrame:
    if ranks is not None:
        return quantiles_of(ranks, value, ps, by)
    return exact_quantiles(positives(df, value), value, ps, by)


def _in_two_passes(
    data: DataFrame, value: str, ps: dict[str, float], aggregates: list[Column], counted: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(one row of aggregates, one row of exact quantiles, their ranks): the sketch is one more aggregate.

    Quantiles are those of the rows where ``counted`` holds; the aggregates are those of all rows.
    """
    number = F.col(value) if counted is None else F.when(counted, F.col(value))
    names = data.withColumn("_number", number)
    first = names.agg(*aggregates, bracket_edges("_number", ps).alias("_edges"))
    row = first.first()
    kept = data if counted is None else data.where(counted)
    found, ranks = quantiles_between(kept.select(value), value, ps, row["_edges"])
    stats = data.sparkSession.createDataFrame([row], first.schema).drop("_edges")
    return stats, found, ranks


def tail_stats(
    df: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    limit: float = EXTREME_LIMIT,
    p: float = TAIL_QUANTILE,
    approx: bool = False,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Per group, over positive values: n, p99, count and percent above the limit, skewness.

    The skewness is the population (biased) one. ``approx`` takes the percentile from a
    sketch in the same pass; otherwise it is exact, by distributed ranks. Without groups the data
    are read twice: one aggregate gives the statistics and the sketch, one counts around it.
    """
    v = F.col(value)
    skew = F.skewness(v)
    aggregates = [
        F.count("*").alias("n"),
        F.count_if(v > limit).alias("count_ext"),
        F.when(~F.isnan(skew), skew).alias("skewness"),
    ]
    if approx:
        aggregates.append(F.percentile_approx(v, p, 10000).alias("p99"))
    data = positives(df, value)
    if not (by or approx or ranks):
        stats, at_p, _ = _in_two_passes(data, value, {"p99": p}, aggregates)
        stats = stats.withColumn("p99", at_p.scalar())
    else:
        stats = data.groupBy(*by).agg(*aggregates)
    if (by or ranks) and not approx:
        at_p = _tail_quantile(df, value, {"p99": p}, by, ranks)
        stats = match_keys(stats, at_p, by) if by else stats.withColumn("p99", at_p.scalar())
    percent = F.coalesce(F.try_divide(F.col("count_ext"), F.col("n")) * 100, F.lit(0.0))
    return stats.select(*by, "n", "p99", "count_ext", percent.alias("pct_ext"), "skewness")


def survival_curve(
    df: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    floor: float = SURVIVAL_FLOOR,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Empirical survival P(X > x) at every distinct positive value, kept within [floor, 1]."""
    above = F.lit(1.0) - F.col("upto") / F.col("total")
    return (ranks or tail_ranks(df, value, by)).select(
        *by, F.col(value).alias("x"), "cnt", clipped(above, floor, 1.0).alias("survival")
    )


def survival_tail(curve: DataFrame, limit: float = EXTREME_LIMIT) -> DataFrame:
    """Part of a survival curve at or beyond the limit."""
    return curve.filter(F.col("x") >= limit)


def exceedance_at(
    df: DataFrame,
    value: str = "value",
    p: float = TAIL_QUANTILE,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """One row: the percentile of the positive values, and the share of all rows above it."""
    if ranks is None:
        return _exceedance_in_two_passes(df, value, p)
    quantile = _tail_quantile(df, value, {"q": p}, (), ranks)
    over = F.when(clean(F.col(value)) > F.col("q"), 1.0).otherwise(0.0)
    return df.select(value, quantile.scalar().alias("q")).agg(
        F.max("q").alias("q"), F.avg(over).alias("exceedance"), F.count("*").alias("n_all")
    )


def _exceedance_in_two_passes(df: DataFrame, value: str, p: float) -> DataFrame:
    """The same without another pass: the rows above the percentile are those that rank above it."""
    data = df.select(clean(F.col(value)).alias(value))
    stats, at_p, ranks = _in_two_passes(
        data, value, {"q": p}, [F.count("*").alias("n_all")], is_positive(F.col(value))
    )
    if ranks is None:
        none = F.when(F.col("n_all") > 0, 0.0)
        return stats.select(F.lit(None).cast("double").alias("q"), none.alias("exceedance"), "n_all")
    placed = ranks.select(value, "upto", "total", at_p.scalar().alias("q"))
    above = placed.agg(
        F.max("q").alias("q"), (F.max("total") - F.max(F.when(F.col(value) <= F.col("q"), F.col("upto")))).alias("above")
    )
    both = stats.select("n_all", above.select(F.struct("q", "above")).scalar().alias("s"))
    return both.select("s.q", (F.col("s.above") / F.col("n_all")).alias("exceedance"), "n_all")


def histogram(
    df: DataFrame, value: str = "value", bins: int | str = HISTOGRAM_BINS, fill: bool = False
) -> DataFrame:
    """Equal-width histogram: (bin, low, high, n); the last bin is closed.

    ``bins="fd"`` derives the width from the data: 2 * IQR / cube root of n. Empty bins
    are left out unless ``fill`` is set (fixed number of bins only).
    """
    data = df.select(clean(F.col(value)).alias("v")).filter(F.col("v").isNotNull())
    ends = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")]
    if bins == "fd":
        # Ends and sketch in one pass, quartiles in the next, bins in the last.
        bounds, quartiles, _ = _in_two_passes(data, "v", {"q25": 0.25, "q75": 0.75}, ends)
        spread = quartiles.select(F.col("q75") - F.col("q25")).scalar()
        width = 2 * spread / F.cbrt("n")
        count = F.ceil(F.try_divide(F.col("hi") - F.col("lo"), width))
        bounds = bounds.withColumn("k", F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)))
    else:
        bounds = data.agg(*ends).withColumn("k", F.lit(int(bins)).cast("long"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    shape = bounds.select(F.struct("lo", width.alias("width"), "k").alias("s")).scalar()
    at = F.floor(F.try_divide(F.col("v") - F.col("s.lo"), F.col("s.width")))
    bin_of = F.least(F.coalesce(at, F.lit(0)), F.col("s.k") - 1).cast("int")
    placed = data.select("v", shape.alias("s")).select(bin_of.alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    if fill:
        if bins == "fd":
            raise ValueError("fill needs a fixed number of bins")
        every = bounds.filter(F.col("n") > 0).select(
            F.explode(F.sequence(F.lit(0), F.lit(int(bins) - 1))).alias("bin")
        )
        counts = every.join(counts, "bin", "left").withColumn(
            "n", F.coalesce("n", F.lit(0).cast("long"))
        )
    edge = lambda i: F.col("s.lo") + i * F.col("s.width")
    return counts.withColumn("s", shape).select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n"
    )


def kpi_tail(
    df: DataFrame,
    station: str = "location_name",
    value: str = "value",
    target: str | int | None = None,
    title_length: int = 28,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """One row for the metric cards of one station (by default the one with most rows).

    The station is looked up first, so that it reaches the scan as a plain filter.
    ``ranks`` are the tail ranks of that station.
    """
    target = busiest_station(df, station) if target is None else target
    own = df.filter(F.col(station) == target)
    return tail_stats(own, value, ranks=ranks).select(
        text.truncated(F.lit(target).cast("string"), title_length).alias("station"), "*"
    )


def busiest_station(df: DataFrame, station: str = "location_name") -> str | int | None:
    """Name of the station with most rows; None for an empty table."""
    row = busiest(df, station).first()
    return None if row is None else row[station]
