"""Which stations report what: discovery, missing parameters, coverage of the period."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions import time
from stationlake.functions.values import clean
from stationlake.functions.vocabulary import (
    PARAMETER_IDS,
    PARAMETER_NAMES,
    WINDOW_DAYS,
    classify_zone,
    normalise_parameter,
)


def _measures(ids: Sequence[int]) -> Callable[[Column], Column]:
    """Condition on a sensor: its parameter is one of ``ids``."""
    return lambda sensor: sensor["parameter"]["id"].isin(list(ids))


def discover_locations(
    locations: DataFrame,
    groups: Mapping[str, Sequence[int]] = PARAMETER_IDS,
    count: int | None = None,
) -> DataFrame:
    """Locations whose sensors cover every group (any id of the group counts).

    Looks only at each row's own sensor list, so nothing is shuffled; ``count`` keeps
    the first locations by id.
    """
    covered = reduce(
        lambda a, b: a & b, [F.exists("sensors", _measures(ids)) for ids in groups.values()]
    )
    found = locations.filter(covered)
    return found if count is None else found.orderBy("id").limit(count)


def sensor_groups(sensors: DataFrame, dim: DataFrame, key: str = "param_id") -> DataFrame:
    """Sensors with their parameter group; sensors of unknown parameters are dropped."""
    return sensors.join(dim, key)


def first_sensors(
    locations: DataFrame, groups: Mapping[str, Sequence[int]] = PARAMETER_IDS
) -> DataFrame:
    """First sensor (in list order) of each group at each location."""
    picks = [
        F.struct(
            F.lit(group).alias("param_group"),
            F.try_element_at(F.filter("sensors", _measures(ids)), F.lit(1)).alias("sensor"),
        )
        for group, ids in groups.items()
    ]
    return locations.select(
        F.col("id").alias("location_id"), F.inline(F.array(*picks))
    ).filter(F.col("sensor").isNotNull()).select(
        "location_id",
        "param_group",
        F.col("sensor.id").alias("sensor_id"),
        F.col("sensor.parameter.id").alias("param_id"),
        F.col("sensor.parameter.name").alias("param_name"),
    )


def sensors_to_fetch(
    locations: DataFrame,
    landed: DataFrame,
    groups: Mapping[str, Sequence[int]] = PARAMETER_IDS,
    names: Mapping[str, Sequence[str]] = PARAMETER_NAMES,
) -> DataFrame:
    """First sensors of the groups that a location has not landed yet.

    ``landed`` is (location_id, parameter): the series there are, under any known name of
    their parameter. A location with every group landed gives no row.
    """
    present = landed.select(
        "location_id", normalise_parameter(F.col("parameter"), "null", names).alias("param_group")
    ).filter(F.col("param_group").isNotNull()).distinct()
    return first_sensors(locations, groups).join(present, ["location_id", "param_group"], "left_anti")


def first_per_group(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` (unique per key), for sensors kept one per row.

    An aggregate, not a window: a hot key is reduced to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    firsts = [F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest]]
    return df.groupBy(*keys).agg(*firsts).select(*df.columns)


def lookup_sensor(
    locations: DataFrame,
    location_id: int | None,
    names: Sequence[str] = PARAMETER_NAMES["pm25"],
) -> DataFrame:
    """Id of the first sensor named (in lower case) as one of ``names``, at one location or all."""
    matching = F.filter("sensors", lambda s: F.lower(s["parameter"]["name"]).isin(list(names)))
    wanted = locations if location_id is None else locations.filter(F.col("id") == location_id)
    return wanted.select("id", "name", F.try_element_at(matching, F.lit(1))["id"].alias("sensor_id"))


def stations_with_all(
    df: DataFrame, keys: Sequence[str], group: str = "parameter", at_least: int = len(PARAMETER_IDS)
) -> DataFrame:
    """Keys that report at least so many distinct parameters, with the number."""
    counts = df.groupBy(*keys).agg(F.count_distinct(F.col(group)).alias("param_count"))
    return counts.filter(F.col("param_count") >= at_least)


def parameter_counts(df: DataFrame, parameter: str = "parameter") -> DataFrame:
    """Rows per parameter."""
    return df.groupBy(parameter).agg(F.count("*").alias("n"))


def valid_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per key: values present (``c``) and values that are numbers, not NaN (``valid_c``)."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("c"), F.count(clean(F.col(value))).alias("valid_c")
    )


def missing_report(
    df: DataFrame,
    station: str = "location_name",
    parameter: str = "parameter",
    value: str = "value",
    expected: Sequence[str] | None = None,
    ruleset: str | None = None,
) -> DataFrame:
    """Per station: the parameters it reports, their number, rows and valid rows.

    Readings are first reduced to one row per (station, parameter), so the list holds
    parameter names, not readings. With ``expected`` the missing ones are listed too,
    with ``ruleset`` the zone of the station name.
    """
    per_parameter = valid_counts(df, [station, parameter], value)
    report = per_parameter.groupBy(station).agg(
        F.sort_array(F.collect_set(parameter)).alias("params"),
        F.count(parameter).alias("n_params"),
        F.sum("c").alias("c"),
        F.sum("valid_c").alias("valid_c"),
    )
    if ruleset is not None:
        report = report.withColumn("zone", classify_zone(F.col(station), ruleset))
    if expected is None:
        return report
    wanted = F.array(*[F.lit(p) for p in expected])
    return report.withColumn("missing", F.sort_array(F.array_except(wanted, F.col("params"))))


def coverage(
    df: DataFrame,
    start: str,
    end: str,
    keys: Sequence[str] = ("station_id",),
    ts: str = "ts",
    window_days: int = WINDOW_DAYS,
) -> DataFrame:
    """Observed against expected hours per key and half-open window of the period.

    Every key seen gets every window, also the empty ones: its per-window counts (at
    most one per window) are spread over the window list, with no grid join.
    """
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    at = F.col(ts).cast("timestamp")
    inside = (at >= first) & (at < last)
    seconds = F.unix_timestamp(at) - F.unix_timestamp(first)
    hours = df.groupBy(
        *keys, F.when(inside, F.floor(seconds / 3600)).cast("long").alias("_hour")
    ).agg(F.lit(1).alias("_one"))
    per_window = hours.groupBy(
        *keys, F.floor(F.col("_hour") / (24 * window_days)).cast("int").alias("_win")
    ).agg(F.count("_hour").alias("_n"))
    return spread_windows(per_window, start, end, keys, window_days)


def spread_windows(
    per_window: DataFrame, start: str, end: str, keys: Sequence[str], window_days: int = WINDOW_DAYS
) -> DataFrame:
    """Coverage from (keys, ``_win``, ``_n``): hours seen per window; ``_win`` is NULL outside the period."""
    windows = time.period_windows(start, end, window_days)
    per_key = per_window.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_win").isNotNull(), F.struct("_win", "_n"))))
        .alias("_seen")
    )
    spread = per_key.select(*keys, "_seen", F.inline(windows))
    observed = F.coalesce(F.try_element_at("_seen", F.col("win")), F.lit(0).cast("long"))
    span = F.unix_timestamp("win_end") - F.unix_timestamp("win_start")
    expected = F.ceil(span / 3600).cast("long")
    return spread.select(
        *keys, "win", "win_start", "win_end",
        observed.alias("observed"),
        expected.alias("expected"),
        F.when(observed == 0, "missing").when(observed < expected, "partial").otherwise("full")
        .alias("status"),
    )


def missing_hours(
    df: DataFrame, start: str, end: str, keys: Sequence[str] = ("station_id",), ts: str = "ts"
) -> DataFrame:
    """One row per run of missing hours of a key: (gap_start, gap_end exclusive, hours).

    Hours are deduplicated per key first, so a key's window holds at most the hours of
    the period however many readings it has.
    """
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    at = F.col(ts).cast("timestamp")
    n_hours = F.ceil((F.unix_timestamp(last) - F.unix_timestamp(first)) / 3600).cast("long")
    hour = F.floor((F.unix_timestamp(at) - F.unix_timestamp(first)) / 3600).cast("long")
    inside = (at >= first) & (at < last)
    # Hour -1 stands for all time outside, so that a key seen only there keeps a row.
    placed = F.when(inside, hour).otherwise(F.lit(-1).cast("long"))
    hours = df.select(*keys, placed.alias("h")).distinct()
    by_hour = Window.partitionBy(*keys).orderBy("h")
    around = hours.select(
        *keys,
        "h",
        F.lag("h", 1, -1).over(by_hour).alias("_last"),
        F.lead("h").over(by_hour).alias("_next"),
    )
    # The gap before each hour, and after the last one the gap to the end.
    gaps = F.array(
        F.struct((F.col("_last") + 1).alias("a"), F.col("h").alias("b")),
        F.struct((F.col("h") + 1).alias("a"), F.when(F.col("_next").isNull(), n_hours).alias("b")),
    )
    found = around.select(*keys, F.inline(F.filter(gaps, lambda g: g["b"] > g["a"])))
    origin = F.unix_timestamp(first)
    return found.select(
        *keys,
        F.timestamp_seconds(origin + F.col("a") * 3600).alias("gap_start"),
        F.timestamp_seconds(origin + F.col("b") * 3600).alias("gap_end"),
        (F.col("b") - F.col("a")).alias("hours"),
    )
