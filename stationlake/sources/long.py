"""Long CSV files: one reading per line, columns by each file's own header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake import schemas
from stationlake.functions import time, values
from stationlake.sources.shared import staged

NAMES = [f.name for f in schemas.LONG_CSV.fields]
# Lines are read as text and cut here, at the commas outside quotes. The CSV reader takes columns by
# position, and once a query uses only some of them it no longer notices a line of the wrong length.
# A line with quotes gets this mark, which is no character, in place of its cutting commas.
_MARK = "\uffff"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, source_file) of long CSV files."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file")
    )


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same lines as a stream: each run sees only files not seen before, and those whole."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file")
    )


def read_long(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of long CSV files.

    A line with another number of fields than its header, unpaired quotes, an unreadable number or
    an unreadable time goes to the rejects with its file name; all other lines are kept. Both
    results hold the same lines whatever columns are asked for, and come from one parse: stage
    ``parsed_lines`` first where both are read.
    """
    return split_rejects(read_lines(spark, path))


def _once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)``, worked out once a row whatever is done with the result.

    The columns pass through a generator of one row. Without it the optimiser copies their
    expressions into every filter and column that names them. They are worked out below the
    generator, where parts that they share are too.
    """
    made = df.select(*columns)
    return made.select(F.inline(F.array(F.struct(*made.columns))))


def _plain(df: DataFrame, names: list[str]) -> DataFrame:
    """The named fields without their quotes and outer blanks; empty ones are NULL.

    In steps, so that no step holds an expression twice.
    """
    trimmed = df.withColumns({n: F.trim(n) for n in names})
    quoted = lambda n: F.contains(n, F.lit('"'))
    unquoted = lambda n: F.trim(F.replace(F.regexp_replace(n, r'^"|"$', ""), F.lit('""'), F.lit('"')))
    bare = trimmed.withColumns({n: F.when(quoted(n), unquoted(n)).otherwise(F.col(n)) for n in names})
    return bare.withColumns({n: F.when(F.col(n) != "", F.col(n)) for n in names})


def _fields(line: Column) -> Column:
    """The fields of a line: cut at its commas, but for those inside quotes."""
    between = F.split(line, '"')
    marked = F.transform(
        between, lambda part, k: F.when(k % 2 == 0, F.translate(part, ",", _MARK)).otherwise(part)
    )
    return F.when(F.contains(line, F.lit('"')), F.split(F.array_join(marked, '"'), _MARK, -1)).otherwise(
        F.split(line, ",", -1)
    )


def _names(line: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(line), '[" \\t\\r\ufeff]', ""), ",")


def _is_header(line: Column) -> Column:
    """A line that names at least the time, the parameter and the value, each as a whole field."""
    needed = ("timestamp", "parameter", "value")
    found = F.lit(True)
    for n in needed:  # rules out nearly every line before it is cut
        found = found & F.contains(F.lower(line), F.lit(n))
    for n in needed:
        found = found & F.array_contains(_names(line), n)
    return found


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every line of (line, source_file) but headers and blank ones, parsed once.

    Columns are those of the long layout, typed, then ``ts``, ``source_file``, ``line`` and
    ``ok``. A line is not ok if it has another number of fields than its header, quotes without a
    partner, or an unreadable number or time. Files without a header, or with the usual one,
    need no lookup; only the layouts of other files are collected, and their staged size decides how
    lines meet them.
    """
    usual = F.array(*[F.lit(n) for n in NAMES])
    filled = lines.where(F.trim("line") != "")
    layouts = staged(
        filled.where(_is_header(F.col("line"))).select("source_file", _names(F.col("line")).alias("layout"))
        .where(F.col("layout") != usual).groupBy("source_file").agg(F.min("layout").alias("layout")),
        "long-layouts",
    )
    cut = _once(
        filled.where(~_is_header(F.col("line"))),
        "source_file", "line", _fields(F.col("line")).alias("fields"),
        (F.contains("line", F.lit('"')) & ((F.size(F.split("line", '"')) % 2 == 0) | F.contains("line", F.lit(_MARK))))
        .alias("broken"),
    )
    known = cut.join(layouts, "source_file", "left").withColumn("layout", F.coalesce("layout", usual))
    named = known.select(
        "source_file", "line", "broken", (F.size("fields") == F.size("layout")).alias("fits"),
        *[F.try_element_at("fields", F.nullif(F.array_position("layout", n), F.lit(0)).cast("int")).alias(n) for n in NAMES],
    )
    texts = _once(_plain(named, NAMES), *named.columns)
    numbers = [f for f in schemas.LONG_CSV.fields if not isinstance(f.dataType, T.StringType)]
    typed = _once(
        texts, "source_file", "line", "broken", "fits",
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schemas.LONG_CSV.fields],
        *[F.col(f.name).isNotNull().alias(f"{f.name}_given") for f in numbers],
        time.timestamp_of(F.col("timestamp")).alias("ts"),
    )
    ok = F.col("fits") & ~F.col("broken") & F.col("ts").isNotNull()
    for f in numbers:
        ok = ok & (F.col(f.name).isNotNull() | ~F.col(f"{f.name}_given"))
    return typed.select(*NAMES, "ts", "source_file", "line", ok.alias("ok"))


def split_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (line, source_file) rows into (typed good rows, rejected lines)."""
    return split_parsed(parsed_lines(lines))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of parsed lines."""
    return parsed.where("ok").select(*NAMES, "ts", "source_file"), parsed.where("not ok").select("source_file", "line")


def to_readings(rows: DataFrame) -> DataFrame:
    """Long CSV rows in the canonical columns; rows without a readable time are dropped."""
    if "ts" not in rows.columns:
        rows = rows.withColumn("ts", time.timestamp_of(F.col("timestamp")))
    timed = rows.where(F.col("ts").isNotNull())
    return values.conform(
        timed.withColumn("station_id", F.col("location_id").cast("string"))
        .withColumn("value", values.clean(F.col("value"))),
        schemas.READINGS,
    )


def write_long(readings: DataFrame, path: str) -> None:
    """Export as long CSV with header, blank for NULL; ids as text, times to the microsecond."""
    out = readings.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "parameter", "value", "units", "location_name",
        F.col("station_id").cast("string").alias("location_id"),
    )
    out.write.option("header", True).option("escape", '"').csv(path)
