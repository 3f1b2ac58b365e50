"""Timelines, year alignment, pivots and their completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.catalog.registry import query, rounded, table
from stationlake.functions import time
from stationlake.operators import timeline, wide
from stationlake.operators.reconcile import reconcile, reconcile_summary

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""
SELECT user_id, event_id, row_number() OVER w AS row_idx,
       TIMESTAMP '2025-01-01' + to_hours(row_number() OVER w - 1) AS ts, value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def timeline_rebuild(spark, folder):
    """Hour k of 2025 for the k-th event of each user."""
    events = table(spark, folder, "events").select("user_id", "event_id", "value")
    return timeline.timeline_from_order(events, ["user_id"], ["event_id"])


@query("""
SELECT o_orderkey, make_timestamp(2025, month(o_orderdate), day(o_orderdate), hour(o_orderdate),
                                  minute(o_orderdate), second(o_orderdate)::DOUBLE) AS ts_2025
FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)
""")
def year_align(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return time.align_year(orders, "o_orderdate", 2025, "ts_2025").drop("o_orderdate")


def _weeks(spark, folder):
    events = table(spark, folder, "events")
    week = F.date_trunc("week", F.col("ts")).alias("week")
    return wide.station_pivot(events, ["user_id", week], "event_type", "value", TYPES)


_PIVOT = "SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, " + ", ".join(
    f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in TYPES
) + " FROM events GROUP BY 1, 2"
_WHOLE = " AND ".join(f"{t} IS NOT NULL" for t in TYPES)


@query(f"""
SELECT user_id, week, {", ".join(f"round({t}, 6) AS {t}" for t in TYPES)}
FROM ({_PIVOT}) WHERE {_WHOLE}
""")
def station_week_pivot(spark, folder):
    return rounded(wide.complete_cases(_weeks(spark, folder), TYPES), *TYPES)


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS column_name, count(*) FILTER (WHERE {t} IS NULL) AS nulls FROM ({_PIVOT})"
    for t in TYPES
))
def pivot_null_report(spark, folder):
    return wide.null_report(_weeks(spark, folder), TYPES)


@query(f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_WHOLE}) AS rows_after,
       count(*) - count(*) FILTER (WHERE {_WHOLE}) AS removed
FROM ({_PIVOT})
""")
def pivot_completeness(spark, folder):
    return wide.completeness_counts(_weeks(spark, folder), TYPES)


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_stations FROM events")
def table_size(spark, folder):
    return wide.table_size(table(spark, folder, "events"), "user_id")


_RECONCILED = """
SELECT o_orderkey, round(a, 2) AS a, round(b, 2) AS b, round(a - b, 2) AS diff,
       CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b'
            WHEN abs(a - b) <= 0.005 THEN 'match' ELSE 'differ' END AS status
FROM (SELECT o_orderkey, avg(o_totalprice) AS a FROM orders GROUP BY 1)
FULL JOIN (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1)
USING (o_orderkey)
"""


def _order_totals(spark, folder):
    stated = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    summed = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("value")
    )
    return reconcile(stated, summed, ["o_orderkey"], tolerance=0.005)


@query(_RECONCILED)
def reconcile_orders(spark, folder):
    return rounded(_order_totals(spark, folder), "a", "b", "diff", digits=2)


_PEAKS = """
SELECT user_id, event_type, day, a, b, a - b AS diff,
       CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b'
            WHEN abs(a - b) <= 0 THEN 'match' ELSE 'differ' END AS status
FROM (SELECT user_id, event_type, day(ts)::INT AS day, max(value) AS a FROM events WHERE value <= 100 GROUP BY 1, 2, 3)
FULL JOIN (SELECT user_id, event_type, day(ts)::INT AS day, max(value) AS b FROM events WHERE value > 10 GROUP BY 1, 2, 3)
USING (user_id, event_type, day)
"""


def _peaks(spark, folder):
    events = table(spark, folder, "events").withColumn("day", F.dayofmonth("ts"))
    keys = ["user_id", "event_type", "day"]
    peak = lambda part: part.groupBy(*keys).agg(F.max("value").alias("value"))
    return reconcile(peak(events.filter("value <= 100")), peak(events.filter("value > 10")), keys)


@query(_PEAKS)
def reconcile_peaks(spark, folder):
    """Highest reading per series and day from two sources with different ranges.

    One source misses values above 100, the other those up to 10: all four outcomes occur.
    """
    return _peaks(spark, folder)


@query(f"""
SELECT status, count(*) AS n, round(avg(abs(diff)), 6) AS mean_abs_diff,
       round(max(abs(diff)), 6) AS max_abs_diff
FROM ({_PEAKS}) GROUP BY 1
""")
def reconcile_peaks_summary(spark, folder):
    return rounded(reconcile_summary(_peaks(spark, folder)), "mean_abs_diff", "max_abs_diff")
