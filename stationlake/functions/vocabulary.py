"""Parameter groups, zone keywords and thresholds.

Fixed values: they decide which readings match and which rows count, so they are
stated here as text and nowhere else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
PARAMETER_IDS = {
    "pm25": [2],
    "pm10": [1],
    "no2": [5, 15],
    "ozone": [3, 10, 32],
    "temperature": [100],
    "humidity": [98, 134],
}
PARAMETER_NAMES = {
    "pm25": ["pm2.5", "pm25"],
    "pm10": ["pm10"],
    "no2": ["no2"],
    "ozone": ["o3", "ozone"],
    "temperature": ["temperature"],
    "humidity": ["humidity", "relativehumidity"],
}
FEATURES = ["pm25", "pm10", "no2", "ozone", "temperature", "humidity"]

# Zone rule sets: (keywords, case sensitive).
ZONE_RULES = {
    "default": (["manali", "talkatora", "solapur", "industrial", "district", "midc"], False),
    "narrow": (["manali", "talkatora", "solapur", "industrial"], False),
    "cased": (["Ind", "MID"], True),
}
ZONE_MATCH = "Industrial"
ZONE_OTHER = "Residential"

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

VIOLATION_LIMIT = 35
EXTREME_LIMIT = 200
TAIL_QUANTILE = 0.99
HISTOGRAM_BINS = 63
SURVIVAL_FLOOR = 1e-6
TIMELINE_START = "2025-01-01 00:00:00"
TIMELINE_YEAR = 2025
WINDOW_DAYS = 30


def normalise_parameter(
    raw: Column, unmatched: str = "null", names: Mapping[str, Sequence[str]] = PARAMETER_NAMES
) -> Column:
    """Group name of a raw parameter name, compared in lower case.

    ``unmatched`` says what an unknown name becomes: ``"null"``, ``"other"`` or
    ``"keep"`` (the lower-cased name itself).
    """
    lowered = F.lower(raw)
    group = F.coalesce(*[F.when(lowered.isin(list(known)), F.lit(g)) for g, known in names.items()])
    if unmatched == "null":
        return group
    if unmatched == "other":
        return F.when(lowered.isNotNull(), F.coalesce(group, F.lit("other")))
    if unmatched == "keep":
        return F.coalesce(group, lowered)
    raise ValueError(f"unmatched must be null, other or keep, not {unmatched!r}")


def classify_zone(
    name: Column,
    ruleset: str = "default",
    rules: Mapping[str, tuple[Sequence[str], bool]] = ZONE_RULES,
    match: str = ZONE_MATCH,
    other: str = ZONE_OTHER,
) -> Column:
    """``match`` when the name contains a keyword of the rule set, else ``other``."""
    keywords, cased = rules[ruleset]
    text = name if cased else F.lower(name)
    hit = reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])
    return F.when(hit, F.lit(match)).otherwise(F.lit(other))


def parameter_dim(
    spark: SparkSession, ids: Mapping[str, Sequence[int]] = PARAMETER_IDS
) -> DataFrame:
    """(param_id, param_group) as a small local table."""
    rows = [(pid, group) for group, group_ids in ids.items() for pid in group_ids]
    return spark.createDataFrame(rows, "param_id long, param_group string")
