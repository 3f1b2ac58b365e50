"""Positions, running counts and exact quantiles without a single-task window.

A window ordered over a whole table, or over a station that holds a third of it, would
run in one task. Here rows are ranged on (group, order) so that a group may span many
partitions; every partition counts its share of each group, and the shares of the
earlier partitions are added as an offset. The ranged rows are staged first, so that
the partition numbers are data and cannot change between the two reads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions.values import clean
from stationlake.sources.joins import match_keys
from stationlake.sources.shared import staged

def _offsets(parts: DataFrame, by: Sequence[str], weight: Column, *more: Column) -> DataFrame:
    """Per (partition, group): what the earlier partitions hold, and the group's total.

    One row per partition and group; a window here sees at most one row per partition.
    """
    shares = parts.groupBy("_part", *by).agg(F.sum(weight).alias("_share"), *more)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select(
        "*",
        F.coalesce(F.sum("_share").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_share").over(Window.partitionBy(*by)).alias("_total"),
    ).drop("_share")
    # One row per partition and group: the size of the written table decides the join.
    return staged(offsets, "offsets")


def numbered(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    into: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Row number (from 1) within each group by ``order``; the order key must be unique.

    ``total`` names a column for the size of the group. One range shuffle of the rows.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    row = F.monotonically_increasing_id()
    rows = staged(
        ranged.select("*", F.spark_partition_id().alias("_part"), row.alias("_row")), "numbered"
    )
    offsets = _offsets(rows, by, F.lit(1).cast("long"), F.min("_row").alias("_first"))
    joined = match_keys(rows, offsets, ["_part", *by])
    out = joined.withColumn(into, F.col("_before") + F.col("_row") - F.col("_first") + 1)
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_row", "_first", "_before", "_total")


def running_sums(
    df: DataFrame, weight: str, order: Sequence[str | Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``upto``, the sum of ``weight`` up to and including each row, and the group's ``total``.

    The order key must be unique within a group.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = staged(_summed_in_order(ranged, weight), "sums")
    # A group is a stretch of its partition: what stands before the stretch is taken off.
    start = F.min(F.col("_upto") - F.col(weight)).alias("_start")
    joined = match_keys(rows, _offsets(rows, by, F.col(weight), start), ["_part", *by])
    return joined.select(
        *df.columns, (F.col("_before") + F.col("_upto") - F.col("_start")).alias("upto"),
        F.col("_total").alias("total"),
    )


def _summed_in_order(ranged: DataFrame, weight: str) -> DataFrame:
    """Add ``_upto``, the sum of ``weight`` from the start of the partition, and ``_part``.

    A window would shuffle the rows once more to its own partitioning; they are already
    where they belong, so each task adds them up as they come.
    """
    fields = ranged.withColumn("_part", F.spark_partition_id()).schema.fields
    schema = T.StructType([*fields, T.StructField("_upto", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        before = 0
        for batch in batches:
            share = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
            upto = before + np.cumsum(share.astype(np.int64))
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(upto, pa.int64())], names=[*batch.schema.names, "_upto"]
            )

    return ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(add, schema)


def running_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value: ``cnt`` rows, ``upto`` rows at or below it, ``total`` rows.

    Rows are first counted per distinct value (combined before the shuffle, so a value
    holding a third of the rows is one row afterwards).
    """
    present = df.filter(F.col(value).isNotNull())
    distinct = present.groupBy(*by, value).agg(F.count("*").alias("cnt"))
    return running_sums(distinct, "cnt", [value], by)


def exact_quantiles(
    df: DataFrame, value: str, ps: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``ps``.

    The built-in ``percentile`` gathers all distinct values of a group in one task. Here the
    ranks are looked for within narrow brackets, of the whole column or of each group, and only
    the values inside a bracket are ranked, across tasks.
    """
    return bracketed_by_group(df, value, ps, by) if by else bracketed_quantiles(df, value, ps)


def bracketed_quantiles(
    df: DataFrame, value: str, ps: dict[str, float], accuracy: int = 10000, margin: float = 2.0
) -> DataFrame:
    """Exact quantiles of a whole column without sorting it.

    A sketch gives two values around each wanted rank (``margin`` times its error apart on
    either side). Everything outside these brackets is only counted, before the shuffle;
    the few values inside are ranked exactly. Should a rank lie outside its bracket after
    all, every value is ranked instead.
    """
    v = F.col(value)
    data = df.select(clean(v).alias(value)).filter(v.isNotNull())
    edges = data.agg(bracket_edges(value, ps, accuracy, margin).alias("e")).first()["e"]
    return quantiles_between(data, value, ps, edges)[0]


def bracket_edges(value: str, ps: dict[str, float], accuracy: int = 10000, margin: float = 2.0) -> Column:
    """Aggregate: a value below and one above each wanted rank, from a sketch; NULL without values."""
    slack = margin / accuracy
    around = [edge for p in ps.values() for edge in (max(p - slack, 0.0), min(p + slack, 1.0))]
    return F.percentile_approx(F.col(value), around, accuracy)


def quantiles_between(
    data: DataFrame, value: str, ps: dict[str, float], edges: Sequence[float] | None
) -> tuple[DataFrame, DataFrame | None]:
    """(one row of quantiles, the ranks they are read from) given the edges around their ranks.

    The ranks are (value, cnt, upto, total): the values inside the brackets, and rows with a NULL
    value for what lies between and outside.
    """
    v = F.col(value)
    schema = ", ".join(f"`{name}` double" for name in ps)
    spark = data.sparkSession
    if edges is None:
        return spark.createDataFrame([tuple(None for _ in ps)], schema), None
    brackets: list[list[float]] = []
    for low, high in sorted(zip(edges[::2], edges[1::2])):
        if brackets and low <= brackets[-1][1]:
            brackets[-1][1] = max(brackets[-1][1], high)
        else:
            brackets.append([low, high])
    # Segments in value order: even ones lie outside the brackets, odd ones inside.
    segment = F.lit(2 * len(brackets))
    for i in reversed(range(len(brackets))):
        low, high = brackets[i]
        segment = F.when(v < low, 2 * i).when(v <= high, 2 * i + 1).otherwise(segment)
    marked = data.select(segment.alias("_segment"), value)
    counts = marked.groupBy(
        "_segment", F.when(F.col("_segment") % 2 == 1, v).alias(value)
    ).agg(F.count("*").alias("cnt"))
    ranks = running_sums(counts, "cnt", ["_segment", value])
    found = quantiles_of(ranks, value, ps).first()
    if any(q is None for q in found):
        ranks = running_counts(data, value)
        found = quantiles_of(ranks, value, ps).first()
    return spark.createDataFrame([tuple(found)], schema), ranks


def bracketed_by_group(
    df: DataFrame, value: str, ps: dict[str, float], by: Sequence[str], accuracy: int = 1000, margin: float = 2.0
) -> DataFrame:
    """Exact quantiles of each group without ranking all of its values.

    A sketch per group brackets the wanted ranks; the table of brackets, one row a group, is staged, and
    its size decides how it meets the values. Values outside the brackets of their group are only
    counted, before the shuffle; those inside are ranked across tasks. A group of fewer values than
    ``accuracy`` has exact brackets. Groups with a rank outside its bracket after all are ranked whole.
    """
    v = F.col(value)
    data = df.select(*by, clean(v).alias(value)).filter(v.isNotNull())
    edges = bracket_edges(value, ps, accuracy, margin)
    brackets = staged(data.groupBy(*by).agg(edges.alias("_edges")), "group-brackets")
    marked = match_keys(data, brackets, by)
    pairs = range(len(ps))
    low = lambda i: F.col("_edges")[2 * i]
    high = lambda i: F.col("_edges")[2 * i + 1]
    # Brackets may overlap: a value inside any keeps its place, others only count between the edges.
    inside = F.lit(False)
    for i in pairs:
        inside = inside | ((v >= low(i)) & (v <= high(i)))
    below = sum((v > high(i)).cast("int") for i in pairs)
    counts = marked.groupBy(
        *by, F.when(~inside, below).alias("_gap"), F.when(inside, v).alias(value)
    ).agg(F.count("*").alias("cnt"), F.min(v).alias("_at"))
    ranks = running_sums(counts, "cnt", ["_at"], by)
    found = staged(quantiles_of(ranks, value, ps, by), "group-quantiles")
    missed = found.where(reduce(lambda a, b: a | b, [F.col(name).isNull() for name in ps])).select(*by)
    if missed.isEmpty():
        return found
    whole = match_keys(data, missed, by, "left_semi")
    return match_keys(found, missed, by, "left_anti").unionByName(
        quantiles_of(running_counts(whole, value, by), value, ps, by)
    )


def quantiles_of(
    ranks: DataFrame, value: str, ps: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles read off the result of ``running_counts``."""
    first = F.col("upto") - F.col("cnt")
    picks, outs = [], []
    for name, p in ps.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            at_rank = (first <= rank) & (rank < F.col("upto"))
            picks.append(F.max(F.when(at_rank, F.col(value))).alias(f"_{side}_{name}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_w_{name}"))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((low + (high - low) * F.col(f"_w_{name}")).alias(name))
    return ranks.groupBy(*by).agg(*picks).select(*by, *outs)


def top(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows by ``order`` (a top-n report; each task keeps n rows)."""
    return df.orderBy(*order).limit(n)


def busiest(df: DataFrame, station: str) -> DataFrame:
    """One row: the station with most rows (smallest name among equals)."""
    counts = df.groupBy(station).agg(F.count("*").alias("n"))
    return top(counts, [F.col("n").desc(), F.col(station)], 1)
