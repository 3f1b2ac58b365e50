"""Station means next to the population they expose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions import text
from stationlake.functions.values import clean
from stationlake.functions.vocabulary import classify_zone


def station_means(
    df: DataFrame,
    station: str = "station_id",
    value: str = "value",
    names: DataFrame | None = None,
    name: str = "location_name",
    into: str = "pm25_mean",
) -> DataFrame:
    """Mean value per location name.

    Readings are summed per station before names are joined; stations sharing a name
    are then merged by their sums and counts, which gives the mean of all readings.
    Without ``names`` the readings carry the name themselves.
    """
    v = clean(F.col(value))
    if names is None:
        return df.groupBy(name).agg(F.avg(v).alias(into))
    sums = df.groupBy(station).agg(F.sum(v).alias("_sum"), F.count(v).alias("_n"))
    sums = sums.join(names, station)
    return sums.groupBy(name).agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias(into))


def exposure(
    means: DataFrame,
    density: DataFrame,
    key: str = "location_name",
    name: str = "location_name",
    ruleset: str = "cased",
    separator: str = ",",
) -> DataFrame:
    """Station means with short name, population density (NULL if unknown) and zone.

    A key given several densities takes the largest, so no station is repeated.
    """
    others = [F.max(c).alias(c) for c in density.columns if c != key]
    return means.join(density.groupBy(key).agg(*others), key, "left").withColumns({
        "short_name": text.short_label(F.col(name), separator),
        "zone": classify_zone(F.col(name), ruleset),
    })
