"""Discovery, first sensors, missing parameters and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.catalog.registry import query, table
from stationlake.functions.vocabulary import classify_zone, normalise_parameter
from stationlake.operators import completeness as c
from stationlake.sources import locations as loc

# Stand-in parameter ids: the leading digit of the order priority.
GROUPS = {"urgent": [1], "high": [2], "rest": [4, 3], "low": [5]}
NAMES = {"web": ["click", "view"], "sale": ["purchase"]}


def customer_sensors(spark, folder):
    """Customers as locations: one sensor per order priority, in the order first used.

    Orders are reduced to one row per (customer, priority) before they become a list,
    so no list is longer than the number of priorities.
    """
    digit = F.substring("o_orderpriority", 1, 1).cast("long")
    first_use = table(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.min("o_orderkey").alias("id")
    )
    parameter = F.struct(
        digit.alias("id"),
        F.substring("o_orderpriority", 3, 20).alias("name"),
        F.lit("orders").alias("units"),
    )
    sensors = first_use.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("id", parameter.alias("parameter")))).alias("sensors")
    )
    customer = table(spark, folder, "customer")
    return customer.join(sensors, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "sensors"
    )


_DIVISION = """
SELECT c_custkey AS id, c_name AS name FROM customer
JOIN (SELECT o_custkey, count(DISTINCT CASE left(o_orderpriority, 1)
        WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'rest' END) AS g
      FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE g = 4
"""


@query(_DIVISION)
def discover_locations(spark, folder):
    return c.discover_locations(customer_sensors(spark, folder), GROUPS).select("id", "name")


@query(_DIVISION + " ORDER BY id LIMIT 100")
def discover_first_hundred(spark, folder):
    """The report of the first hundred covering locations by id."""
    return c.discover_locations(customer_sensors(spark, folder), GROUPS, 100).select("id", "name")


_USES = """
SELECT o_custkey AS location_id, min(o_orderkey) AS sensor_id, left(o_orderpriority, 1)::BIGINT AS param_id,
       substr(o_orderpriority, 3) AS param_name
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 3, 4
"""
_GROUP = "CASE param_id WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' WHEN 5 THEN 'low' ELSE 'rest' END"


@query(f"""
SELECT location_id, {_GROUP} AS param_group, min(sensor_id) AS sensor_id,
       arg_min(param_id, sensor_id) AS param_id, arg_min(param_name, sensor_id) AS param_name
FROM ({_USES}) GROUP BY 1, 2
""")
def first_sensor(spark, folder):
    return c.first_sensors(customer_sensors(spark, folder), GROUPS)


@query(f"""
SELECT c_custkey AS id, c_name AS name, sensor_id FROM customer
LEFT JOIN (SELECT location_id, min(sensor_id) AS sensor_id FROM ({_USES})
           WHERE lower(param_name) IN ('low', 'not specified') GROUP BY 1) ON location_id = c_custkey
""")
def sensor_by_name(spark, folder):
    """First sensor with one of the names, at every location."""
    return c.lookup_sensor(customer_sensors(spark, folder), None, ["low", "not specified"])


@query("""
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value
FROM events GROUP BY 1, 2
""")
def first_event(spark, folder):
    """The same choice where each sensor is a row of its own."""
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return c.first_per_group(events, ["user_id", "event_type"], "event_id")


@query(f"""
SELECT {_GROUP} AS param_group, count(*) AS n, count(DISTINCT location_id) AS n_locations
FROM ({_USES}) WHERE param_id <> 5 GROUP BY 1
""")
def sensor_groups(spark, folder):
    """Lookup of the parameter group; sensors of unknown parameters are dropped."""
    known = [(pid, g) for g, ids in GROUPS.items() if g != "low" for pid in ids]
    dim = spark.createDataFrame(known, "param_id long, param_group string")
    sensors = loc.explode_sensors(customer_sensors(spark, folder))
    return c.sensor_groups(sensors, dim).groupBy("param_group").agg(
        F.count("*").alias("n"), F.count_distinct("location_id").alias("n_locations")
    )


@query("""
SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, count(DISTINCT event_type) AS param_count
FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 5
""")
def stations_all_params(spark, folder):
    events = table(spark, folder, "events").withColumn("week", F.date_trunc("week", "ts"))
    return c.stations_with_all(events, ["user_id", "week"], "event_type", 5)


@query("""
SELECT user_id, count(DISTINCT g) AS param_count FROM (
  SELECT user_id, date_trunc('day', ts) AS day,
         CASE WHEN lower(event_type) IN ('click', 'view') THEN 'web'
              WHEN lower(event_type) = 'purchase' THEN 'sale' ELSE 'other' END AS g
  FROM events WHERE value IS NOT NULL)
WHERE g <> 'other' GROUP BY 1 HAVING param_count >= 2
""")
def stations_full_coverage(spark, folder):
    """Stations with every known group, after normalising with 'other' for the rest."""
    events = table(spark, folder, "events").filter("value IS NOT NULL").withColumn(
        "g", normalise_parameter(F.col("event_type"), "other", NAMES)
    )
    return c.stations_with_all(events.filter("g <> 'other'"), ["user_id"], "g", 2)


@query("""
SELECT event_type,
       CASE WHEN lower(event_type) IN ('click', 'view') THEN 'web' WHEN lower(event_type) = 'purchase' THEN 'sale' END AS as_null,
       CASE WHEN lower(event_type) IN ('click', 'view') THEN 'web' WHEN lower(event_type) = 'purchase' THEN 'sale' ELSE 'other' END AS as_other,
       CASE WHEN lower(event_type) IN ('click', 'view') THEN 'web' WHEN lower(event_type) = 'purchase' THEN 'sale' ELSE lower(event_type) END AS as_kept,
       count(*) AS n
FROM events GROUP BY 1
""")
def param_normalise(spark, folder):
    raw = F.col("event_type")
    named = table(spark, folder, "events").select(
        raw, *[normalise_parameter(raw, mode, NAMES).alias(f"as_{into}")
               for mode, into in (("null", "null"), ("other", "other"), ("keep", "kept"))]
    )
    return named.groupBy(*named.columns).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def param_counts(spark, folder):
    return c.parameter_counts(table(spark, folder, "events"), "event_type")


@query("""
SELECT user_id, week, string_agg(event_type, ',' ORDER BY event_type) AS params, count(*) AS n_params,
       sum(c)::BIGINT AS c, sum(valid_c)::BIGINT AS valid_c,
       coalesce(array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'],
                lambda x: NOT list_contains(list(event_type), x))), ','), '') AS missing
FROM (SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(value) AS c,
             count(CASE WHEN value <= 200 THEN value END) AS valid_c
      FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def missing_params(spark, folder):
    """Parameters each station reported in a week; values above 200 stand in for NaN."""
    readings = table(spark, folder, "events").select(
        F.struct("user_id", F.date_trunc("week", "ts").alias("week")).alias("station"),
        "event_type",
        F.when(F.col("value") > 200, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    expected = ["click", "error", "purchase", "signup", "view"]
    report = c.missing_report(readings, "station", "event_type", "value", expected)
    return report.select(
        "station.*", F.array_join("params", ",").alias("params"), "n_params", "c", "valid_c",
        F.array_join("missing", ",").alias("missing"),
    )


START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


COVERAGE_SQL = f"""
WITH wins AS (SELECT i::INT AS win, TIMESTAMP '{START}' + to_days((i * 7)::INT) AS win_start,
                     least(TIMESTAMP '{START}' + to_days((i * 7 + 7)::INT), TIMESTAMP '{END}') AS win_end
              FROM generate_series(0, 4) AS s(i)),
seen AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events
         WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'),
grid AS (SELECT * FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN wins),
counts AS (SELECT grid.user_id, win, win_start, win_end, count(h) AS observed,
                  date_diff('hour', win_start, win_end) AS expected
           FROM grid LEFT JOIN seen ON seen.user_id = grid.user_id AND h >= win_start AND h < win_end
           GROUP BY ALL)
SELECT *, CASE WHEN observed = 0 THEN 'missing' WHEN observed < expected THEN 'partial' ELSE 'full' END AS status
FROM counts
"""


@query(COVERAGE_SQL)
def coverage(spark, folder):
    events = table(spark, folder, "events")
    return c.coverage(events, START, END, ["user_id"], "ts", window_days=7)


@query(f"""
WITH hours AS (SELECT DISTINCT user_id, date_diff('hour', TIMESTAMP '{START}', date_trunc('hour', ts)) AS h FROM events
               WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'),
marks AS (SELECT * FROM hours UNION SELECT user_id, -1 FROM events),
nexts AS (SELECT user_id, h, coalesce(lead(h) OVER (PARTITION BY user_id ORDER BY h), 720) AS nx FROM marks)
SELECT user_id, TIMESTAMP '{START}' + to_hours(h + 1) AS gap_start, TIMESTAMP '{START}' + to_hours(nx) AS gap_end,
       nx - h - 1 AS hours
FROM nexts WHERE nx > h + 1
""")
def coverage_gaps(spark, folder):
    return c.missing_hours(table(spark, folder, "events"), START, END, ["user_id"])


@query("""
SELECT p_partkey,
       CASE WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'promo') THEN 'Industrial' ELSE 'Residential' END AS zone,
       CASE WHEN contains(p_type, 'MED') OR contains(p_type, 'small') THEN 'Industrial' ELSE 'Residential' END AS zone_cased
FROM part
""")
def zone_classify(spark, folder):
    rules = {"plain": (["small", "promo"], False), "cased": (["MED", "small"], True)}
    kind = F.col("p_type")
    return table(spark, folder, "part").select(
        "p_partkey",
        classify_zone(kind, "plain", rules).alias("zone"),
        classify_zone(kind, "cased", rules).alias("zone_cased"),
    )


# Names under which a landed series of a group may stand.
ALIASES = {"urgent": ["urgent", "asap"], "high": ["high"], "rest": ["medium", "not specified"], "low": ["low"]}


@query(f"""
WITH uses AS (
  SELECT location_id, {_GROUP} AS param_group, min(sensor_id) AS sensor_id,
         arg_min(param_id, sensor_id) AS param_id, arg_min(param_name, sensor_id) AS param_name
  FROM ({_USES}) GROUP BY 1, 2),
landed AS (
  SELECT DISTINCT o_custkey AS location_id, CASE left(o_orderpriority, 1)
    WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'rest' END AS param_group
  FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM uses ANTI JOIN landed USING (location_id, param_group)
""")
def sensors_to_fetch(spark, folder):
    """Finished orders are landed series; some stand under another name or spelling."""
    name = F.substring("o_orderpriority", 3, 20)
    spelled = F.when(name == "URGENT", F.when(F.col("o_orderkey") % 2 == 0, "ASAP").otherwise("Urgent")).otherwise(name)
    landed = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("location_id"), spelled.alias("parameter")
    )
    return c.sensors_to_fetch(customer_sensors(spark, folder), landed, GROUPS, ALIASES)
