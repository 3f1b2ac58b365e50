"""Fixed schemas of every table that is read or written; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SENSOR = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("parameter", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("units", T.StringType()),
    ])),
])

LOCATION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("sensors", T.ArrayType(SENSOR)),
])

# Long CSV layout: one header line, one reading per line.
LONG_CSV = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("units", T.StringType()),
    T.StructField("location_name", T.StringType()),
    T.StructField("location_id", T.StringType()),
])

# One landed page of measurements. ``datetimeFrom`` arrives either as a struct
# with a ``utc`` field or as plain text, so it is read as text first.
PAGE = T.StructType([
    T.StructField("location_id", T.LongType()),
    T.StructField("location_name", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("units", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("value", T.DoubleType()),
        T.StructField("period", T.StructType([T.StructField("datetimeFrom", T.StringType())])),
    ]))),
])

READINGS = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("location_name", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("units", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("source_file", T.StringType()),
])

# One row a parameter, station and day; rows of the same key are added up, their hours united.
DAILY = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("location_name", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("hits", T.LongType()),
    T.StructField("hours", T.IntegerType()),
])

# One row a parameter and day: a sketch of the stations that reported a number; sketches are united.
STATION_SKETCHES = T.StructType([
    T.StructField("parameter", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("n", T.LongType()),
    T.StructField("stations", T.BinaryType()),
])
