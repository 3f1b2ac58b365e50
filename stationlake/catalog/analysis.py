"""The whole analyses on stand-in readings.

Order lines are the readings: the supplier is the station, the month of shipping the
hour, and the line number within the order picks one of the six parameters (lines
beyond the sixth are an unknown parameter).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.catalog.components import component_sql
from stationlake.catalog.registry import query, rounded, table
from stationlake.functions.values import conform
from stationlake.functions.vocabulary import FEATURES, MONTHS, normalise_parameter
from stationlake.plans import analyses
from stationlake.sources.readings import attach_location
from stationlake.sources.shared import staged


def _names(spark, folder):
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    industrial = F.when(F.col("n_regionkey") <= 1, " Industrial Area").otherwise("")
    names = table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").cast("string").alias("station_id"),
        F.concat("n_name", industrial, F.lit(", "), "s_name").alias("location_name"),
    )
    return staged(names, "names")


def _readings(spark, folder):
    parameter = F.try_element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("l_linenumber"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("station_id"),
        F.coalesce(parameter, F.lit("other")).alias("parameter"),
        F.date_trunc("month", "l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"),
    )
    return conform(lines, schemas.READINGS)


_NAMES = """
SELECT s_suppkey, concat(n_name, CASE WHEN n_regionkey <= 1 THEN ' Industrial Area' ELSE '' END, ', ', s_name)
       AS location_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
_ROWS = f"""
SELECT location_name, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, l_quantity AS value,
       coalesce([{", ".join(f"'{f}'" for f in FEATURES)}][l_linenumber], 'other') AS parameter
FROM lineitem JOIN ({_NAMES}) ON l_suppkey = s_suppkey
"""
_FEATURE_ROWS = f"""
SELECT * FROM (
  SELECT location_name, ts, {", ".join(f"avg(CASE WHEN parameter = '{f}' THEN value END) AS {f}" for f in FEATURES)},
         CASE WHEN contains(lower(location_name), 'industrial') THEN 'Industrial' ELSE 'Residential' END AS zone
  FROM ({_ROWS}) GROUP BY 1, 2)
WHERE {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)}
"""


@query(f"""
SELECT location_name, ts, zone, {", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)} FROM ({_FEATURE_ROWS})
""")
def feature_table(spark, folder):
    named = attach_location(_readings(spark, folder), _names(spark, folder))
    return rounded(analyses.feature_table(named), *FEATURES)


@query(component_sql("""
SELECT (SELECT count(*) FROM scores) AS records, round((e1.l + e2.l) / 6, 6) AS variance_captured,
       round(e1.l / 6, 6) AS pc1_variance, round(e2.l / 6, 6) AS pc2_variance,
       round(sqrt(power(i1 - r1, 2) + power(i2 - r2, 2)), 6) AS centroid_gap
FROM (SELECT avg(PC1) FILTER (WHERE zone = 'Residential') AS r1, avg(PC2) FILTER (WHERE zone = 'Residential') AS r2,
             avg(PC1) FILTER (WHERE zone = 'Industrial') AS i1, avg(PC2) FILTER (WHERE zone = 'Industrial') AS i2
      FROM scores) CROSS JOIN e1 CROSS JOIN e2
""", _FEATURE_ROWS, FEATURES, "location_name, ts"))
def pca_analysis(spark, folder):
    named = attach_location(_readings(spark, folder), _names(spark, folder))
    cards = analyses.pca_analysis(named).kpi
    return rounded(cards, "variance_captured", "pc1_variance", "pc2_variance", "centroid_gap")


_LEVELS = {"pressing": ["1-urgent", "2-high"], "normal": ["3-medium", "4-not specified", "5-low"]}


@query("""
SELECT * FROM (
  SELECT o_orderstatus AS station,
         make_timestamp(2025, month(o_orderdate), day(o_orderdate), 0, 0, 0.0::DOUBLE) AS ts_aligned,
         round(avg(CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN o_totalprice END), 6) AS pressing,
         round(avg(CASE WHEN left(o_orderpriority, 1) IN ('3', '4', '5') THEN o_totalprice END), 6) AS normal
  FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29) GROUP BY 1, 2)
WHERE pressing IS NOT NULL AND normal IS NOT NULL
""")
def aligned_features(spark, folder):
    """Orders of all years as readings of one year: day by status, a column per urgency."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("station"),
        F.col("o_orderdate").alias("ts"),
        normalise_parameter(F.col("o_orderpriority"), names=_LEVELS).alias("parameter"),
        F.col("o_totalprice").alias("value"),
    )
    features = list(_LEVELS)
    return rounded(analyses.aligned_features(orders, 2025, "station", features), *features)


_RATES = ", ".join(
    f"avg(CASE WHEN value > 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE month(ts) = {m}) AS {n}"
    for m, n in enumerate(MONTHS, 1)
)


@query(f"""
SELECT *, round(list_avg(list_filter([{", ".join(MONTHS)}], lambda x: x IS NOT NULL)), 6) AS row_mean
FROM (SELECT split_part(location_name, ',', 1) AS label, {_RATES}
      FROM ({_ROWS}) WHERE parameter = 'pm25' GROUP BY 1)
""")
def violation_analysis(spark, folder):
    matrix = analyses.violation_analysis(_readings(spark, folder), _names(spark, folder))
    return rounded(matrix, "row_mean")


@query(f"""
WITH s AS (SELECT location_name, value FROM ({_ROWS}) WHERE parameter = 'pm25'),
busiest AS (SELECT location_name FROM s GROUP BY 1 ORDER BY count(*) DESC, location_name LIMIT 1),
own AS (SELECT value FROM s JOIN busiest USING (location_name) WHERE value > 0)
SELECT DISTINCT value AS x, count(*) OVER (PARTITION BY value) AS cnt,
       greatest(1e-6::DOUBLE, round(1.0::DOUBLE - cume_dist() OVER (ORDER BY value), 9)) AS survival
FROM own
""")
def tail_analysis(spark, folder):
    named = attach_location(_readings(spark, folder), _names(spark, folder))
    return rounded(analyses.tail_analysis(named).survival, "survival", digits=9)


@query(f"""
WITH means AS (SELECT location_name, avg(value) AS m FROM ({_ROWS}) WHERE parameter = 'pm25' GROUP BY 1),
density AS (SELECT location_name, count(*) AS pop_density
            FROM ({_NAMES}) JOIN supplier USING (s_suppkey) JOIN customer ON c_nationkey = s_nationkey GROUP BY 1)
SELECT location_name, round(m, 6) AS pm25_mean, pop_density, split_part(location_name, ',', 1) AS short_name,
       CASE WHEN contains(location_name, 'Ind') OR contains(location_name, 'MID') THEN 'Industrial' ELSE 'Residential' END AS zone
FROM means LEFT JOIN density USING (location_name)
""")
def exposure_analysis(spark, folder):
    names = _names(spark, folder)
    per_nation = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(
        F.count("*").alias("pop_density")
    )
    suppliers = table(spark, folder, "supplier").join(per_nation, "s_nationkey").select(
        F.col("s_suppkey").cast("string").alias("station_id"), "pop_density"
    )
    density = names.join(suppliers, "station_id").select("location_name", "pop_density")
    return rounded(analyses.exposure_analysis(_readings(spark, folder), names, density), "pm25_mean")
