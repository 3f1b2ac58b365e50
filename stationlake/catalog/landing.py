"""Reading and writing every source format.

The raw folders are written by Spark from the supplied tables into the shared folder,
then read back by the readers; their size grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.catalog.completeness import COVERAGE_SQL, END, START, customer_sensors
from stationlake.catalog.registry import query, rounded, table
from stationlake.functions.values import conform
from stationlake.operators import timeline
from stationlake.sources import bare, colocated, locations, long, pages, readings, snapshots
from stationlake.sources.shared import new_path, staged
from stationlake.streaming import daily, ingest


def event_readings(spark, folder):
    """Events in the canonical columns."""
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("station_id"),
        F.concat(F.lit("Station, "), "user_id").alias("location_name"),
        F.col("event_type").alias("parameter"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.lit("u").alias("units"),
    )
    return conform(events, schemas.READINGS)


@query("""
SELECT c_custkey AS id, c_name AS name, coalesce(n, 0)::INT AS n_sensors FROM customer
LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def location_scan(spark, folder):
    path = new_path(spark, "locations")
    locations.write_locations(customer_sensors(spark, folder), path)
    return locations.sensor_counts(locations.read_locations(spark, path, multiline=False))


@query("""
SELECT row_number() OVER (ORDER BY event_id) AS rn, CASE WHEN event_type <> 'error' THEN value END AS value
FROM events
""")
def scan_order(spark, folder):
    """Lines of bare files in scan order; error events are blank lines."""
    path = new_path(spark, "lines")
    value = F.when(F.col("event_type") != "error", F.col("value").cast("string"))
    events = table(spark, folder, "events").orderBy("event_id")
    events.select(F.coalesce(value, F.lit("")).alias("line")).write.text(path)
    lines = bare.read_lines(spark, path)
    return timeline.scan_positions(lines).select("rn", "value")


def _write_bare(spark, folder):
    """Station folders of bare text files; values above 150 are blank lines."""
    path = new_path(spark, "bare")
    value = F.when(F.col("value") <= 150, F.col("value").cast("string"))
    table(spark, folder, "events").repartitionByRange("event_type", "event_id").sortWithinPartitions(
        "event_type", "event_id"
    ).select(
        F.coalesce(value, F.lit("")).alias("line"), F.col("event_type").alias("station")
    ).write.partitionBy("station").text(path)
    return path


_BARE = """
SELECT event_type AS station_id, count(*) AS n_lines, count(CASE WHEN value <= 150 THEN 1 END) AS n_values,
       round(sum(CASE WHEN value <= 150 THEN value END), 6) AS total, count(*) AS numbered
FROM events GROUP BY 1
"""


@query(_BARE)
def bare_folders(spark, folder):
    """Station folders of bare files: every line numbered once, blanks included.

    A station's lines may be spread over several files; ``numbered`` adds up the last
    line number of each file.
    """
    raw = bare.read_bare(spark, _write_bare(spark, folder), file_filter="*.txt")
    lines = timeline.rebuild_timeline(raw, drop_missing=False)
    per_file = lines.groupBy("station_id", "source_file").agg(
        F.count("*").alias("n_lines"), F.count("value").alias("n_values"),
        F.sum("value").alias("total"), F.max("row_idx").alias("last"),
    )
    return per_file.groupBy("station_id").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_values").alias("n_values"),
        F.round(F.sum("total"), 6).alias("total"), F.sum("last").alias("numbered"),
    )


@query("""
SELECT CASE WHEN event_type = 'error' AND value > 100 THEN 'reject' ELSE 'good' END AS kind,
       event_type AS parameter, count(*) AS n,
       round(sum(CASE WHEN event_type = 'error' AND value > 100 THEN NULL ELSE value END), 6) AS total
FROM events GROUP BY 1, 2
""")
def long_scan(spark, folder):
    """Long CSV with some unreadable numbers: good rows and rejected lines."""
    path = new_path(spark, "long")
    bad = (F.col("parameter") == "error") & (F.col("value") > 100)
    event_readings(spark, folder).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "parameter",
        F.when(bad, "broken").otherwise(F.col("value").cast("string")).alias("value"),
        "units", "location_name", F.col("station_id").alias("location_id"),
    ).write.option("header", True).csv(path)
    good, rejects = long.read_long(spark, path)
    read = long.to_readings(good).select(F.lit("good").alias("kind"), "parameter", "value")
    refused = rejects.select(
        F.lit("reject").alias("kind"),
        F.split_part("line", F.lit(","), F.lit(2)).alias("parameter"),
        F.lit(None).cast("double").alias("value"),
    )
    return read.unionByName(refused).groupBy("kind", "parameter").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


@query("""
WITH k AS (SELECT *, CASE WHEN event_type = 'error' AND value > 100 THEN 'short' WHEN event_type = 'click' AND value > 100
  THEN 'wide' WHEN event_type = 'view' AND value > 120 THEN 'no time' ELSE 'good' END AS kind FROM events)
SELECT CASE WHEN kind = 'good' THEN 'good' ELSE 'reject' END AS kind, count(*) AS n,
       round(sum(CASE WHEN kind = 'good' THEN value END), 6) AS total,
       count(DISTINCT CASE WHEN kind = 'good' THEN date_trunc('second', ts) END) AS n_times
FROM k GROUP BY 1
""")
def long_layouts(spark, folder):
    """Long files with other headers, lines of the wrong length, times as objects and times that are none."""
    path = new_path(spark, "layouts")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    as_object = F.concat(F.lit("\"{'utc': '"), stamp, F.lit("', 'local': 'x'}\""))
    kept = event_readings(spark, folder)
    over = F.col("value") > 100
    line = F.when((F.col("parameter") == "error") & over, F.concat_ws(",", stamp, "parameter", "value")).when(
        (F.col("parameter") == "click") & over,
        F.concat_ws(",", stamp, "parameter", "value", "units", F.lit("A"), "station_id", F.lit("more")),
    ).when(
        (F.col("parameter") == "view") & (F.col("value") > 120),
        F.concat_ws(",", F.lit("no time"), "parameter", "value", "units", F.lit("A"), "station_id"),
    ).otherwise(F.concat_ws(",", as_object, "parameter", "value", "units", F.lit("\"A, b\""), "station_id"))
    kept.filter("parameter <> 'purchase'").select(line.alias("line")).write.text(f"{path}/usual")
    kept.filter("parameter = 'purchase'").select(
        F.col("station_id").alias("location_id"), "value", stamp.alias("timestamp"), "parameter"
    ).write.option("header", True).csv(f"{path}/other")
    good, rejects = long.read_long(spark, f"{path}/*")
    read = long.to_readings(good).select(F.lit("good").alias("kind"), "value", "ts")
    refused = rejects.select(
        F.lit("reject").alias("kind"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("timestamp").alias("ts")
    )
    return read.unionByName(refused).groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count_distinct("ts").alias("n_times")
    )


@query("""
SELECT event_type AS parameter, count(*) AS n, count(DISTINCT user_id) AS n_stations,
       round(sum(CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 2 * value ELSE value END), 6) AS total
FROM events GROUP BY 1
""")
def refetch(spark, folder):
    """Series fetched again replace themselves; other stations of the parameter stay."""
    path = new_path(spark, "refetched")
    first = event_readings(spark, folder)
    readings.write_readings(first, path)
    again = first.filter("parameter = 'click' and cast(station_id as long) % 2 = 0")
    readings.write_readings(again.withColumn("value", 2 * F.col("value")), path)
    return readings.read_readings(spark, path).groupBy("parameter").agg(
        F.count("*").alias("n"), F.count_distinct("station_id").alias("n_stations"),
        F.round(F.sum("value"), 6).alias("total"),
    )


@query("""
SELECT station_id, row_idx, TIMESTAMP '2025-01-01' + INTERVAL 1 HOUR * (row_idx - 1) AS ts, value FROM (
  SELECT concat(event_type, '-', event_id % 5) AS station_id, CASE WHEN value <= 150 THEN event_id::DOUBLE END AS value,
         row_number() OVER (PARTITION BY event_type, event_id % 5 ORDER BY event_id) AS row_idx FROM events)
""")
def line_times(spark, folder):
    """Place and hour of every line: each value is the event's id, so that no line can pass for another."""
    path = new_path(spark, "places")
    station = F.concat_ws("-", "event_type", (F.col("event_id") % 5).cast("string"))
    value = F.when(F.col("value") <= 150, F.col("event_id").cast("string"))
    # One file a station, as the fetched series are.
    table(spark, folder, "events").select(
        "event_id", F.coalesce(value, F.lit("")).alias("line"), station.alias("station")
    ).repartition("station").sortWithinPartitions("station", "event_id").select("line", "station").write.partitionBy(
        "station"
    ).text(path)
    raw = bare.read_bare(spark, path, file_filter="*.txt")
    return timeline.rebuild_timeline(raw, drop_missing=False).select("station_id", "row_idx", "ts", "value")


@query("""
SELECT user_id::VARCHAR AS station_id, event_type AS parameter, date_trunc('second', ts)::TIMESTAMP AS ts, value
FROM events
""")
def landed_pages(spark, folder):
    """Measurement pages (at most 1000 results each) landed as readings."""
    path = new_path(spark, "pages")
    started = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    result = F.struct("value", F.struct(F.struct(started.alias("utc")).alias("datetimeFrom")).alias("period"))
    table(spark, folder, "events").groupBy(
        F.col("user_id").alias("location_id"),
        F.col("event_type").alias("parameter"),
        F.floor(F.col("event_id") / 1000).alias("page"),
    ).agg(F.collect_list(result).alias("results")).write.json(path)
    landed = pages.land_measurements(pages.read_pages(spark, path))
    return landed.select("station_id", "parameter", "ts", "value")


@query("""
SELECT user_id::VARCHAR AS station_id, event_type AS parameter, count(*) AS n, max(value) AS peak
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
""")
def readings_subset(spark, folder):
    """Two parameters read from the partitioned readings table."""
    path = new_path(spark, "readings")
    readings.write_readings(event_readings(spark, folder), path)
    return readings.read_readings(spark, path, ["click", "view"]).groupBy(
        "station_id", "parameter"
    ).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


@query("""
SELECT event_id, user_id, event_type FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events l WHERE l.value > 150 AND l.user_id = e.user_id AND l.event_type = e.event_type)
""")
def new_series(spark, folder):
    """Readings of series not landed yet; series with a value above 150 count as landed."""
    events = table(spark, folder, "events")
    new = events.select("event_id", "user_id", "event_type")
    return readings.new_only(new, events.filter("value > 150"), ["user_id", "event_type"])


@query("""
SELECT event_type AS station_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least,
       (SELECT count(*) FROM events WHERE value <= 150) AS first_run, 0::BIGINT AS second_run
FROM events WHERE value <= 150 GROUP BY 1
""")
def ingest_bare(spark, folder):
    """Two landing runs over bare station folders; the second finds nothing new."""
    raw, root = _write_bare(spark, folder), new_path(spark, "landed")
    out, checkpoint = f"{root}/readings", f"{root}/checkpoint"
    runs = [ingest.land_bare(spark, raw, out, checkpoint, file_filter="*.txt") for _ in range(2)]
    return readings.read_readings(spark, out).groupBy("station_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least")
    ).withColumns({
        "first_run": F.lit(runs[0]).cast("long"), "second_run": F.lit(runs[1]).cast("long")
    })


@query("""
SELECT event_type AS parameter, count(*) AS n, count(DISTINCT user_id) AS n_stations, round(sum(value), 6) AS total,
       (SELECT count(*) FROM events WHERE event_type <> 'view') AS first_run, 0::BIGINT AS second_run,
       (SELECT count(*) FROM events WHERE event_type = 'view') AS third_run
FROM events GROUP BY 1
""")
def ingest_increment(spark, folder):
    """Three landing runs: most files, nothing new, then the files added since."""
    root = new_path(spark, "increment")
    raw, out, checkpoint = f"{root}/raw", f"{root}/readings", f"{root}/checkpoint"
    events = event_readings(spark, folder)
    long.write_long(events.filter("parameter <> 'view'"), f"{raw}/first")
    runs = [ingest.land_long(spark, f"{raw}/*", out, checkpoint)]
    runs.append(ingest.land_long(spark, f"{raw}/*", out, checkpoint))
    long.write_long(events.filter("parameter = 'view'"), f"{raw}/second")
    runs.append(ingest.land_long(spark, f"{raw}/*", out, checkpoint))
    first, second, third = [F.lit(n).cast("long") for n in runs]
    return readings.read_readings(spark, out).groupBy("parameter").agg(
        F.count("*").alias("n"),
        F.count_distinct("station_id").alias("n_stations"),
        F.round(F.sum("value"), 6).alias("total"),
    ).withColumns({"first_run": first, "second_run": second, "third_run": third})


@query("""
SELECT 1 AS version, event_type AS parameter, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 2
UNION ALL
SELECT 2, event_type, count(*), round(sum(CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 2 * value ELSE value END), 6)
FROM events GROUP BY 2
""")
def refetch_versions(spark, folder):
    """A table before and after series were fetched again: both versions stay whole."""
    path = new_path(spark, "versions")
    first = event_readings(spark, folder)
    readings.write_readings(first, path)
    again = first.filter("parameter = 'click' and cast(station_id as long) % 2 = 0")
    readings.write_readings(again.withColumn("value", 2 * F.col("value")), path)
    both = [readings.read_readings(spark, path, version=v).withColumn("version", F.lit(v)) for v in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("version", "parameter").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


#: Batches of the queries on landing; every event is in one of them.
BATCHES = 9


def _batches(spark, folder):
    events = event_readings(spark, folder)
    number = F.pmod(F.xxhash64("ts", "station_id"), F.lit(BATCHES))
    parted = staged(events.withColumn("number", number), "batches")
    return [parted.where(F.col("number") == k).drop("number") for k in range(BATCHES)]


@query("""
SELECT event_type AS parameter, count(*) AS n, count(DISTINCT user_id) AS n_stations, round(sum(value), 6) AS total,
       true AS few_folders FROM events GROUP BY 1
""")
def landing_compacted(spark, folder):
    """Small batches landed twice each and merged as they pile up: every reading once, few folders."""
    path = new_path(spark, "compacted")
    for k, batch in enumerate(_batches(spark, folder)):
        for _ in range(2):
            snapshots.land(spark, path, batch, "parameter", "events", k)
        readings.compact_readings(spark, path, fan=3)
    held = snapshots.snapshot(spark, path)
    few = spark.createDataFrame([(p, len(held.of([p])) <= 4) for p in {e.value for e in held.entries}],
                                "parameter string, few_folders boolean")
    return readings.read_readings(spark, path).groupBy("parameter").agg(
        F.count("*").alias("n"), F.count_distinct("station_id").alias("n_stations"), F.round(F.sum("value"), 6).alias("total"),
    ).join(few, "parameter")


def _daily(spark, folder):
    """Daily sums of the events, added batch by batch, one of them twice."""
    path = new_path(spark, "daily")
    batches = _batches(spark, folder)
    for k, batch in enumerate(batches):
        daily.land_daily(batch, path, "events", k, fan=4)
    daily.land_daily(batches[2], path, "events", 2)
    return path


@query("""
SELECT event_type AS parameter, user_id::VARCHAR AS station_id, month(ts)::INT AS month,
       avg(CASE WHEN value > 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS violation_rate, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3
""")
def daily_violation_rates(spark, folder):
    held = daily.read_daily(spark, _daily(spark, folder))
    return daily.violation_rates(held, ["parameter", "station_id", F.month("day").alias("month")])


@query("""
SELECT concat('Station, ', user_id) AS location_name, round(avg(value), 6) AS pm25_mean
FROM events WHERE event_type = 'view' GROUP BY 1
""")
def daily_station_means(spark, folder):
    held = daily.read_daily(spark, _daily(spark, folder), ["view"])
    return rounded(daily.means(held), "pm25_mean")


@query(COVERAGE_SQL.replace("user_id", "station_id").replace("FROM events", "FROM (SELECT user_id::VARCHAR AS station_id, ts FROM events)"))
def daily_coverage(spark, folder):
    held = daily.read_daily(spark, _daily(spark, folder))
    return daily.covered(held, START, END, window_days=7)


def _bucketed(spark, folder):
    name = f"readings_{uuid.uuid4().hex}"
    colocated.write_colocated(event_readings(spark, folder), name, 16, new_path(spark, "bucketed"))
    return colocated.read_colocated(spark, name)


@query("""
SELECT user_id::VARCHAR AS station_id, ts::TIMESTAMP AS ts, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click,
       round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS view
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
""")
def colocated_features(spark, folder):
    """Feature rows of a bucketed table: no shuffle after the write."""
    return rounded(colocated.features(_bucketed(spark, folder), ["click", "view"]), "click", "view")


@query("""
SELECT user_id::VARCHAR AS station_id, event_type AS parameter, ts::DATE AS day, count(*) AS n,
       round(sum(value), 6) AS total, count(*) FILTER (WHERE value > 35) AS hits, count(DISTINCT hour(ts)) AS n_hours
FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3
""")
def colocated_daily_sums(spark, folder):
    """Daily sums of a bucketed table, with the number of hours seen."""
    held = colocated.sums(_bucketed(spark, folder))
    return rounded(held.where("n > 0").select(
        "station_id", "parameter", "day", "n", "total", "hits", F.bit_count("hours").cast("long").alias("n_hours")
    ), "total")


@query("""
SELECT event_type AS parameter, month(ts)::INT AS month, count(*) AS n, count(DISTINCT user_id) AS n_stations, true AS within_bound
FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def sketched_stations(spark, folder):
    """Distinct stations by month from sketches added batch by batch, held against the exact count."""
    path = new_path(spark, "sketches")
    batches = _batches(spark, folder)
    for k, batch in enumerate(batches):
        daily.land_sketches(batch, path, "events", k, fan=4)
    month = F.month("day").alias("month")
    held = daily.distinct_stations(spark, path, ["parameter", month]).withColumnRenamed("n_stations", "about")
    exact = event_readings(spark, folder).where("value is not null").groupBy("parameter", F.month("ts").alias("month")).agg(
        F.count_distinct("station_id").alias("n_stations")
    )
    return held.join(exact, ["parameter", "month"]).select(
        "parameter", "month", "n", "n_stations",
        (F.abs(F.col("about") - F.col("n_stations")) <= 0.02 * F.col("n_stations") + 0.5).alias("within_bound"),
    )
