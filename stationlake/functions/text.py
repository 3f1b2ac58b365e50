"""Labels, safe names and keys taken from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of the raw folders and characters unsafe in a folder name.
STATION_PATTERN = r"station=(\d+)"
PARAMETER_PATTERN = r"([^/\\]+)\.csv$"
UNSAFE = "/\\:"


def station_of(path: Column) -> Column:
    """Station id (text) of a path; empty text when the path has none."""
    return F.regexp_extract(path, STATION_PATTERN, 1)


def parameter_of(path: Column) -> Column:
    """File name without ``.csv``; empty text when it is not a CSV path."""
    return F.regexp_extract(path, PARAMETER_PATTERN, 1)


def decoded(path: Column) -> Column:
    """Path with percent escapes resolved; a plus sign stands for itself."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def short_label(name: Column, separator: str = ",") -> Column:
    """Text before the first separator."""
    return F.split_part(name, F.lit(separator), F.lit(1))


def truncated(text: Column, length: int) -> Column:
    """First ``length`` characters, for titles and cards."""
    return F.substring(text, 1, length)


def safe_name(name: Column) -> Column:
    """Name usable as a folder: slash, backslash and colon become underscores."""
    return F.translate(name, UNSAFE, "_" * len(UNSAFE))


def file_prefix(file_name: Column) -> Column:
    """Part of a file name before the first underscore (``pm25_sensor_7.csv`` -> ``pm25``)."""
    return F.split_part(file_name, F.lit("_"), F.lit(1))
