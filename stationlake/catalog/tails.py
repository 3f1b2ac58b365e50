"""Tail statistics, curves, histograms and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.catalog.registry import query, rounded, table
from stationlake.operators import ordering
from stationlake.operators import tails as t


def _stats_sql(source: str, value: str, by: str | None) -> str:
    group = f"{by}, " if by else ""
    joined = f"JOIN means USING ({by})" if by else "CROSS JOIN means"
    return f"""
WITH sample AS (SELECT * FROM {source} WHERE {value} > 0),
means AS (SELECT {group}avg({value}) AS m FROM sample {"GROUP BY " + by if by else ""})
SELECT {group}count(*) AS n, round(quantile_cont({value}, 0.99), 6) AS p99,
       count(*) FILTER (WHERE {value} > 200) AS count_ext,
       round(count(*) FILTER (WHERE {value} > 200) / count(*) * 100, 6) AS pct_ext,
       round(avg(power({value} - m, 3)) / power(avg(power({value} - m, 2)), 1.5), 6) AS skewness
FROM sample {joined} {"GROUP BY " + by if by else ""}
"""


@query(_stats_sql("events", "value", None))
def tail_stats(spark, folder):
    return rounded(t.tail_stats(table(spark, folder, "events")), "p99", "pct_ext", "skewness")


@query(_stats_sql("events", "value", "event_type"))
def tail_stats_by_parameter(spark, folder):
    stats = t.tail_stats(table(spark, folder, "events"), by=["event_type"])
    return rounded(stats, "p99", "pct_ext", "skewness")


@query(_stats_sql("events", "value", "user_id"))
def tail_stats_by_station(spark, folder):
    stats = t.tail_stats(table(spark, folder, "events"), by=["user_id"])
    return rounded(stats, "p99", "pct_ext", "skewness")


_CURVE = """
SELECT DISTINCT value AS x, count(*) OVER (PARTITION BY value) AS cnt,
       greatest(1e-6::DOUBLE, least(1.0::DOUBLE, round(1.0::DOUBLE - cume_dist() OVER (ORDER BY value), 9))) AS survival
FROM events WHERE value > 0
"""


def _curve(spark, folder):
    return rounded(t.survival_curve(table(spark, folder, "events")), "survival", digits=9)


@query(_CURVE)
def survival_curve(spark, folder):
    return _curve(spark, folder)


@query(f"SELECT * FROM ({_CURVE}) WHERE x >= 200")
def survival_tail(spark, folder):
    return t.survival_tail(_curve(spark, folder))


@query("""
SELECT DISTINCT l_suppkey, l_quantity AS x, count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS cnt,
       greatest(1e-6::DOUBLE, round(1.0::DOUBLE - cume_dist() OVER (PARTITION BY l_suppkey ORDER BY l_quantity), 9)) AS survival
FROM lineitem WHERE l_quantity > 0
""")
def survival_curve_by_station(spark, folder):
    curve = t.survival_curve(table(spark, folder, "lineitem"), "l_quantity", ["l_suppkey"])
    return rounded(curve, "survival", digits=9)


@query("""
WITH q AS (SELECT quantile_cont(value, 0.99) AS q FROM events WHERE value > 0)
SELECT round(q, 6) AS q, round(avg(CASE WHEN value > q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS exceedance,
       count(*) AS n_all
FROM events CROSS JOIN q GROUP BY q
""")
def p99_exceedance(spark, folder):
    result = t.exceedance_at(table(spark, folder, "events"))
    return rounded(rounded(result, "q"), "exceedance", digits=9)


def _histogram_sql(source: str, value: str, bins: str) -> str:
    return f"""
WITH bounds AS (SELECT min({value}) AS lo, max({value}) AS hi, {bins} AS k FROM {source}),
shape AS (SELECT lo, (hi - lo) / k AS width, k FROM bounds),
placed AS (SELECT least(floor(({value} - lo) / width), k - 1)::INT AS bin, lo, width FROM {source}, shape)
SELECT bin, round(lo + bin * width, 6) AS low, round(lo + (bin + 1) * width, 6) AS high, count(*) AS n
FROM placed GROUP BY bin, lo, width
"""


@query(_histogram_sql("events", "value", "63"))
def histogram_63(spark, folder):
    return rounded(t.histogram(table(spark, folder, "events")), "low", "high")


@query(_histogram_sql(
    "lineitem", "l_extendedprice",
    "greatest(ceil((max(l_extendedprice) - min(l_extendedprice)) / (2 * (quantile_cont(l_extendedprice, 0.75) "
    "- quantile_cont(l_extendedprice, 0.25)) / cbrt(count(*)))), 1)",
))
def histogram_fd(spark, folder):
    return rounded(t.histogram(table(spark, folder, "lineitem"), "l_extendedprice", "fd"), "low", "high")


@query("""
SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10
""")
def top_stations(spark, folder):
    """The ten stations with most rows."""
    counts = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return ordering.top(counts, [F.col("n").desc(), "user_id"], 10)


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS place FROM events")
def value_order(spark, folder):
    """Every reading's place in the order of values."""
    readings = table(spark, folder, "events").select("event_id", "value")
    return ordering.numbered(readings, ["value", "event_id"], into="place")


@query("""
WITH busiest AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1 ORDER BY c DESC, user_id LIMIT 1),
sample AS (SELECT value FROM events JOIN busiest USING (user_id) WHERE value > 0),
means AS (SELECT avg(value) AS m FROM sample)
SELECT (SELECT user_id::VARCHAR FROM busiest) AS station, count(*) AS n,
       round(quantile_cont(value, 0.99), 6) AS p99,
       count(*) FILTER (WHERE value > 200) AS count_ext,
       round(count(*) FILTER (WHERE value > 200) / count(*) * 100, 6) AS pct_ext,
       round(avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5), 6) AS skewness
FROM sample CROSS JOIN means
""")
def kpi_tail(spark, folder):
    cards = t.kpi_tail(table(spark, folder, "events"), "user_id")
    return rounded(cards, "p99", "pct_ext", "skewness")
