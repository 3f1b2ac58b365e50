"""Line numbers and the hourly timeline of series without timestamps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions import text, time, vocabulary
from stationlake.operators.ordering import numbered, running_sums
from stationlake.sources.shared import staged


def line_numbers(raw: DataFrame) -> DataFrame:
    """Add ``row_idx``, the line number (from 1) within each source file.

    ``raw`` comes from the readers in ``sources.bare``. A file is read in splits, and every
    task numbers the lines of its splits as they come. In the first split of a file that
    is the line number; only lines of later splits, which large files alone have, look up
    how many lines the earlier splits hold. Lines of first splits are never shuffled.

    The numbered lines are staged first: how files are cut into splits depends on the
    cores at hand, and the counts and the lines must come from the same cut even if
    executors are lost in between.
    """
    lines = staged(_numbered_in_split(raw.drop("parameter")), "lines")
    earlier = (
        Window.partitionBy("source_file")
        .orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = _splits(lines).withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    later = before.filter("block_start > 0").select("first_id", "n_before")
    parameter = text.parameter_of(text.decoded(F.col("source_file")))
    first = lines.filter("block_start = 0").withColumn("n_before", F.lit(0).cast("long"))
    rest = lines.filter("block_start > 0").join(staged(later, "splits"), "first_id").select(first.columns)
    placed = first.unionByName(rest)
    return placed.withColumn("row_idx", F.col("n_before") + F.col("in_split")).withColumn(
        "parameter", parameter
    ).drop("n_before", "in_split", "first_id")


def scan_positions(raw: DataFrame, into: str = "rn") -> DataFrame:
    """Add the global row number of each line: files in path order, lines in file order."""
    lines = staged(_numbered_in_split(raw.drop("parameter")), "lines")
    ordered = running_sums(_splits(lines), "n", ["source_file", "block_start"])
    offsets = staged(ordered.select("first_id", (F.col("upto") - F.col("n")).alias("n_before")), "splits")
    # The key is the number of the split's first line: a long, whatever the paths look like.
    placed = lines.join(offsets, "first_id")
    return placed.withColumn(into, F.col("n_before") + F.col("in_split")).drop("n_before", "in_split", "first_id")


def _numbered_in_split(raw: DataFrame) -> DataFrame:
    """Add ``in_split``, the number of a line in its split, and ``first_id``, its split's first line id.

    A task reads whole splits one after another, so it counts until file or block change.
    """
    schema = T.StructType([
        *raw.schema.fields, T.StructField("in_split", T.LongType()), T.StructField("first_id", T.LongType())
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            file = batch.column(names.index("source_file")).dictionary_encode()
            code, paths = file.indices.to_numpy(), file.dictionary
            block = batch.column(names.index("block_start")).to_numpy()
            fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
            at = np.flatnonzero(fresh)
            place = np.arange(batch.num_rows) - np.repeat(at, np.diff(np.concatenate([at, [batch.num_rows]]))) + 1
            if (paths[int(code[0])].as_py(), int(block[0])) == last:
                place[: at[1] if len(at) > 1 else None] += n
            last, n = (paths[int(code[-1])].as_py(), int(block[-1])), int(place[-1])
            ids = batch.column(names.index("line_id")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place), pa.array(ids - place + 1)],
                names=[*names, "in_split", "first_id"],
            )

    return raw.mapInArrow(count, schema)


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: its place, its first line id and its number of lines."""
    return lines.groupBy("first_id", "source_file", "block_start").agg(F.max("in_split").alias("n"))


def rebuild_timeline(
    raw: DataFrame,
    start: str = vocabulary.TIMELINE_START,
    step_seconds: int = 3600,
    drop_missing: bool = True,
) -> DataFrame:
    """Readings of bare files: line k is the k-th step after ``start``.

    Lines are numbered before missing values are dropped, so a blank line keeps its hour.
    """
    timed = line_numbers(raw).select(
        "station_id",
        "parameter",
        time.time_of_position(F.col("row_idx"), start, step_seconds).alias("ts"),
        "value",
        "row_idx",
        "source_file",
    )
    return timed.filter(F.col("value").isNotNull()) if drop_missing else timed


def timeline_from_order(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str | Column],
    start: str = vocabulary.TIMELINE_START,
    step_seconds: int = 3600,
) -> DataFrame:
    """Timeline of a table that carries its order in columns instead of line numbers."""
    rows = numbered(df, order, series, into="row_idx")
    return rows.withColumn("ts", time.time_of_position(F.col("row_idx"), start, step_seconds))
