"""Timestamps: tolerant parsing, line-number time, year alignment, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions.values import utc_text
from stationlake.functions.vocabulary import MONTHS, TIMELINE_START, TIMELINE_YEAR


def timestamp_of(text: Column) -> Column:
    """Timestamp of a text, or of the ``utc`` field of a JSON object given as text; else NULL."""
    return utc_text(F.trim(text)).try_cast("timestamp")


def parse_ts(df: DataFrame, text: str, into: str = "ts") -> DataFrame:
    """Cast text to a timestamp and drop the rows whose text is no timestamp."""
    parsed = df.withColumn(into, F.col(text).try_cast("timestamp"))
    return parsed.filter(F.col(into).isNotNull())


def time_of_position(
    position: Column, start: str = TIMELINE_START, step_seconds: int = 3600
) -> Column:
    """Time of the k-th reading (k from 1) of an evenly spaced series.

    Counts whole seconds as a long, so a series may be longer than an int of hours.
    """
    origin = F.unix_timestamp(F.lit(start).cast("timestamp"))
    return F.timestamp_seconds(origin + (position - 1) * F.lit(step_seconds).cast("long"))


def align_year(
    df: DataFrame, ts: str = "ts", year: int = TIMELINE_YEAR, into: str = "ts_aligned"
) -> DataFrame:
    """Move every timestamp to one year, keeping month to second; 29 February is dropped."""
    t = F.col(ts)
    without_leap_day = df.filter(~((F.month(t) == 2) & (F.dayofmonth(t) == 29)))
    make = (
        F.try_make_timestamp_ntz
        if isinstance(df.schema[ts].dataType, T.TimestampNTZType)
        else F.try_make_timestamp
    )
    return without_leap_day.withColumn(
        into,
        make(F.lit(year), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t)),
    )


def month_name(month: Column) -> Column:
    """Three-letter English name of a month number."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)


def window_index(ts: Column, start: str, days: int) -> Column:
    """Number (from 0) of the half-open window of so many days that holds ``ts``."""
    seconds = F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))
    return F.floor(seconds / (days * 86400)).cast("int")


def window_start(index: Column, start: str, days: int) -> Column:
    """Start of the window with this number."""
    origin = F.unix_timestamp(F.lit(start).cast("timestamp"))
    return F.timestamp_seconds(origin + index.cast("long") * (days * 86400))


def period_windows(start: str | Column, end: str | Column, days: int) -> Column:
    """Array of half-open (win, win_start, win_end) windows covering [start, end)."""
    first, last = [
        (F.lit(edge) if isinstance(edge, str) else edge).cast("timestamp") for edge in (start, end)
    ]
    step = F.expr(f"interval {int(days)} days")
    starts = F.filter(F.sequence(first, last, step), lambda s: s < last)
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.alias("win"), s.alias("win_start"), F.least(s + step, last).alias("win_end")
        ),
    )
