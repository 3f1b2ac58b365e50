"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, in rows and bytes: a worker holds a batch of whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them ends; long jobs here stage what they read again."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back() -> None:
    """Return freed memory to the system: a worker is used again, and would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``df.mapInArrow`` with small batches and workers that give memory back."""
    bounded_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def map_batches(
    df: DataFrame,
    schema: str | T.StructType,
    job: Callable[[pa.RecordBatch], dict[str, object] | None],
    gather: int = 1,
) -> DataFrame:
    """Map each Arrow batch to columns of ``schema``; ``job`` may return None for no rows.

    With ``gather`` batches of a partition are joined until they hold that many rows.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    want = to_arrow_schema(schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= gather:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in gathered(batches) if gather > 1 else batches:
            if not batch.num_rows:
                continue
            found = job(batch)
            if found is not None:
                yield pa.RecordBatch.from_arrays(
                    [_column(found[f.name], f.type) for f in want], schema=want
                )

    return mapped(df, run, schema)


def _column(values, kind):
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def bounded_rows(df: DataFrame, most: int) -> list:
    """Rows of a table that its maker bounds at ``most``; one row more is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows reach the driver")
    return rows


def row_key(*columns: str):
    """A 64-bit key of the columns, null-safe."""
    return F.xxhash64(*[F.col(c) for c in columns])
