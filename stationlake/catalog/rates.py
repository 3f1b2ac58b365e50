"""Violation rates, heatmaps, station means and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.catalog.registry import query, rounded, table
from stationlake.functions.vocabulary import MONTHS
from stationlake.operators import exposure as ex
from stationlake.operators.violations import violation_heatmap as heatmap
from stationlake.operators.violations import violation_rate


@query("""
SELECT l_suppkey, month(l_shipdate)::INT AS month,
       avg(CASE WHEN l_quantity > 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS violation_rate,
       count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def violation_rate_month(spark, folder):
    keys = ["l_suppkey", F.month("l_shipdate").alias("month")]
    return violation_rate(table(spark, folder, "lineitem"), keys, "l_quantity")


@query("""
SELECT hour(ts)::INT AS hour, event_type,
       avg(CASE WHEN value > 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS violation_rate,
       count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def violation_rate_hour(spark, folder):
    return violation_rate(table(spark, folder, "events"), [F.hour("ts").alias("hour"), "event_type"])


@query("""
WITH gaps AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
kept AS (SELECT user_id, avg(CASE WHEN value > 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS violation_rate,
                count(*) AS n FROM gaps WHERE value IS NOT NULL GROUP BY 1),
safe AS (SELECT user_id, avg(CASE WHEN value > 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate_null_safe,
                count(*) AS n_all FROM gaps GROUP BY 1)
SELECT user_id, violation_rate, n, rate_null_safe, n_all FROM kept JOIN safe USING (user_id)
""")
def violation_rate_missing_values(spark, folder):
    """Both treatments of missing readings, with the error events taken as missing."""
    gaps = table(spark, folder, "events").select(
        "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    safe = violation_rate(gaps, ["user_id"], null_as_safe=True).withColumnsRenamed(
        {"violation_rate": "rate_null_safe", "n": "n_all"}
    )
    return violation_rate(gaps, ["user_id"]).join(safe, "user_id")


def _heatmap_sql(label: str, source: str) -> str:
    months = ",\n  ".join(
        f"sum(CASE WHEN month(l_shipdate) = {m} AND l_quantity > 35 THEN 1.0::DOUBLE "
        f"WHEN month(l_shipdate) = {m} THEN 0.0::DOUBLE END) "
        f"/ count(*) FILTER (WHERE month(l_shipdate) = {m}) AS {n}"
        for m, n in enumerate(MONTHS, 1)
    )
    total = " + ".join(f"coalesce({m}, 0.0::DOUBLE)" for m in MONTHS)
    present = " + ".join(f"(CASE WHEN {m} IS NULL THEN 0 ELSE 1 END)" for m in MONTHS)
    return f"""
WITH wide AS (SELECT {label} AS label,
  {months}
FROM {source} GROUP BY 1),
means AS (SELECT *, ({total}) / ({present}) AS row_mean FROM wide)
SELECT *, row_number() OVER (ORDER BY row_mean DESC, label) AS rank FROM means
"""


@query(_heatmap_sql("s_name", "lineitem JOIN supplier ON l_suppkey = s_suppkey"))
def violation_heatmap(spark, folder):
    names = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("location_name")
    )
    lines = table(spark, folder, "lineitem")
    return heatmap(lines, "l_suppkey", "l_shipdate", "l_quantity", names, rank=True)


@query(_heatmap_sql(
    "n_name",
    "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
))
def violation_heatmap_merged_labels(spark, folder):
    """Stations whose names share the text before the comma fall into one row."""
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    names = table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.concat_ws(", ", "n_name", "s_name").alias("location_name"),
    )
    lines = table(spark, folder, "lineitem")
    return heatmap(lines, "l_suppkey", "l_shipdate", "l_quantity", names, rank=True)


@query("""
SELECT s_name AS location_name, round(avg(l_quantity), 6) AS pm25_mean
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""")
def station_means(spark, folder):
    names = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("location_name")
    )
    means = ex.station_means(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity", names)
    return rounded(means, "pm25_mean")


@query("""
WITH means AS (
  SELECT s_suppkey, concat_ws(', ', s_name, n_name) AS location_name, s_nationkey,
         avg(l_quantity) AS pm25_mean
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL),
density AS (SELECT c_nationkey, count(*) AS pop_density FROM customer GROUP BY 1)
SELECT location_name, round(pm25_mean, 6) AS pm25_mean, pop_density,
       split_part(location_name, ',', 1) AS short_name,
       CASE WHEN contains(location_name, 'Ind') OR contains(location_name, 'MID')
            THEN 'Industrial' ELSE 'Residential' END AS zone
FROM means LEFT JOIN density ON s_nationkey = c_nationkey
""")
def exposure(spark, folder):
    """Supplier means with the number of customers of the supplier's nation as density."""
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    stations = table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.concat_ws(", ", "s_name", "n_name").alias("location_name"),
        F.col("s_nationkey").alias("c_nationkey"),
    )
    per_nation = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("pop_density"))
    density = stations.join(per_nation, "c_nationkey").select("location_name", "pop_density")
    names = stations.select("l_suppkey", "location_name")
    means = ex.station_means(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity", names)
    return rounded(ex.exposure(means, density), "pm25_mean")
