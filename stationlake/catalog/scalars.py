"""Labels, safe names, paths, tolerant casts, clipping and conforming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.catalog.registry import query, table
from stationlake.functions import text, time, values
from stationlake.sources.readings import attach_location


@query("""
SELECT page_id, replace(replace(replace(url, '/', '_'), '\\', '_'), ':', '_') AS safe,
       split_part(url, '?', 1) AS label, substr(url, 1, 28) AS card, substr(url, 1, 35) AS title,
       split_part(url, '_', 1) AS prefix, starts_with(url, 'https') AS secure
FROM pages
""")
def safe_names(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        text.safe_name(url).alias("safe"),
        text.short_label(url, "?").alias("label"),
        text.truncated(url, 28).alias("card"),
        text.truncated(url, 35).alias("title"),
        text.file_prefix(url).alias("prefix"),
        url.startswith("https").alias("secure"),
    )


@query("""
SELECT s_suppkey, split_part(s_name, '#', 1) AS before_mark, split_part(s_name, ',', 1) AS label,
       substr(s_name, 1, 12) AS short
FROM supplier
""")
def labels(spark, folder):
    name = F.col("s_name")
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        text.short_label(name, "#").alias("before_mark"),
        text.short_label(name).alias("label"),
        text.truncated(name, 12).alias("short"),
    )


@query("""
SELECT event_id, user_id::VARCHAR AS station_id, event_type AS parameter,
       CASE WHEN user_id > 50 THEN user_id::INT END AS station_number
FROM events
""")
def path_keys(spark, folder):
    """Station and parameter taken back out of a path built for each reading."""
    path = F.concat(F.lit("data/raw/station="), "user_id", F.lit("/"), "event_type", F.lit(".csv"))
    bare = F.when(F.col("user_id") > 50, path).otherwise("data/raw/unnamed.csv")
    return table(spark, folder, "events").select(
        "event_id",
        text.station_of(path).alias("station_id"),
        text.parameter_of(path).alias("parameter"),
        text.station_of(bare).try_cast("int").alias("station_number"),
    )


@query("""
SELECT c_name AS location_name, count(*) AS n, round(sum(value), 6) AS total
FROM events JOIN customer ON c_custkey = user_id GROUP BY 1
""")
def expression_join(spark, folder):
    """Readings joined to names on the station id taken from a path.

    The result is per station, so the readings are summed before the join.
    """
    path = F.concat(F.lit("data/raw/station="), "user_id", F.lit("/"), "event_type", F.lit(".csv"))
    readings = table(spark, folder, "events").select(
        text.station_of(path).alias("station_id"), text.parameter_of(path).alias("parameter"), "value"
    )
    sums = readings.groupBy("station_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("station_id"), F.col("c_name").alias("location_name")
    )
    return attach_location(sums, names).groupBy("location_name").agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total")
    )


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       date_trunc('second', ts)::TIMESTAMP AS parsed, month(ts)::INT AS month, day(ts)::INT AS day,
       hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second,
       ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(ts)] AS month_name
FROM events WHERE event_type <> 'error'
""")
def try_parse(spark, folder):
    """Text read back as numbers and times; error events carry text that is no time."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    texts = table(spark, folder, "events").select(
        "event_id",
        values.number_of(F.get_json_object("props", "$.k")).alias("k"),
        F.when(F.col("event_type") == "error", "oops")
        .when(F.col("event_type") == "click", stamp)
        .otherwise(F.concat(F.lit('{"utc": "'), stamp, F.lit('"}'))).alias("raw"),
    ).withColumn("raw", values.utc_text(F.col("raw")))
    t = F.col("parsed")
    return time.parse_ts(texts, "raw", "parsed").select(
        "event_id", "k", "parsed",
        F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"),
        F.minute(t).alias("minute"), F.second(t).alias("second"),
        time.month_name(F.month(t)).alias("month_name"),
    )


@query("""
SELECT event_id, greatest(10.0::DOUBLE, least(100.0::DOUBLE, value)) AS clipped,
       CASE WHEN event_type <> 'error' THEN value END AS cleaned,
       CASE WHEN event_type <> 'error' AND value > 0 THEN true ELSE false END AS positive
FROM events
""")
def value_rules(spark, folder):
    """Clipping, NaN clean-up and the positive test, with error events made NaN."""
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, folder, "events").select(
        "event_id",
        values.clipped(F.col("value"), 10.0, 100.0).alias("clipped"),
        values.clean(v).alias("cleaned"),
        values.is_positive(v).alias("positive"),
    )


@query("""
SELECT event_id, user_id::VARCHAR AS station_id, event_type AS parameter, value,
       NULL::VARCHAR AS units
FROM events
""")
def conform(spark, folder):
    """A table brought to a wanted column list; the missing column is filled with NULL."""
    wanted = T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("units", T.StringType()),
    ])
    events = table(spark, folder, "events").withColumnsRenamed(
        {"user_id": "station_id", "event_type": "parameter"}
    )
    return values.conform(events, wanted)


@query("""
SELECT o_orderkey, win::INT AS win,
       TIMESTAMP '1995-01-01' + to_days((win * 30)::INT) AS win_start
FROM (SELECT o_orderkey, floor(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 30) AS win FROM orders)
""")
def order_windows(spark, folder):
    """The 30-day window each order falls in."""
    start, days = "1995-01-01", 30
    return table(spark, folder, "orders").select(
        "o_orderkey", time.window_index(F.col("o_orderdate"), start, days).alias("win")
    ).withColumn("win_start", time.window_start(F.col("win"), start, days))


@query("""
SELECT o_orderstatus, i::INT AS win, s AS win_start, least(s + to_days(30), b) AS win_end
FROM (SELECT o_orderstatus, i, a + to_days((i * 30)::INT) AS s, b
      FROM (SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderdate) + to_days(1) AS b FROM orders GROUP BY 1)
      CROSS JOIN generate_series(0, 2000) AS g(i)) WHERE s < b
""")
def period_windows(spark, folder):
    """All 30-day windows between the first and the last order of each status."""
    spans = table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.min("o_orderdate").cast("timestamp").alias("a"),
        (F.max("o_orderdate").cast("timestamp") + F.expr("interval 1 day")).alias("b"),
    )
    windows = time.period_windows(F.col("a"), F.col("b"), 30)
    return spans.select("o_orderstatus", F.inline(windows))
