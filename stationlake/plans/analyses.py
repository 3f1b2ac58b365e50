"""The four analyses and the landing job, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions.time import align_year
from stationlake.functions.values import conform
from stationlake.functions.vocabulary import (
    FEATURES,
    TIMELINE_START,
    TIMELINE_YEAR,
    classify_zone,
    normalise_parameter,
)
from stationlake.operators import exposure as ex
from stationlake.operators import pca, tails, violations, wide
from stationlake.operators.reconcile import reconcile, reconcile_summary
from stationlake.operators.timeline import rebuild_timeline
from stationlake.sources import bare, locations, long, readings as tables
from stationlake.sources.shared import staged


def load_bare(
    spark: SparkSession,
    root: str,
    metadata: str,
    start: str = TIMELINE_START,
    multiline: bool = True,
    **prune,
) -> DataFrame:
    """Readings of a bare folder: timeline rebuilt, parameters normalised, names attached.

    The names are staged, as the size of the metadata with all its sensors says nothing
    about whether the names alone may be broadcast.
    """
    names = staged(
        locations.station_names(locations.read_locations(spark, metadata, multiline)), "names"
    )
    timeline = rebuild_timeline(bare.read_bare(spark, root, **prune), start)
    known = timeline.withColumn("parameter", normalise_parameter(F.col("parameter")))
    named = tables.attach_location(known.filter(F.col("parameter").isNotNull()), names)
    return conform(named, schemas.READINGS)


def load_long(spark: SparkSession, path: str, unmatched: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(readings, rejected lines) of long CSV files, with parameters normalised."""
    good, rejects = long.read_long(spark, path)
    named = long.to_readings(good).withColumn(
        "parameter", normalise_parameter(F.col("parameter"), unmatched)
    )
    return named, rejects


def aligned_features(
    readings: DataFrame,
    year: int = TIMELINE_YEAR,
    station: str = "location_name",
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Complete feature rows of readings from any year, moved to one year."""
    moved = align_year(readings, "ts", year, "ts_aligned")
    return wide.complete_cases(
        wide.station_pivot(moved, [station, "ts_aligned"], features=features), features
    )


@dataclass(frozen=True)
class PcaResult:
    model: pca.PcaModel
    scores: DataFrame
    loadings: DataFrame
    variance: DataFrame
    centroids: DataFrame
    separation: DataFrame
    kpi: DataFrame


def feature_table(readings: DataFrame, ruleset: str = "default") -> DataFrame:
    """Complete station-hour feature rows with their zone."""
    features = wide.complete_cases(wide.station_pivot(readings, ["location_name", "ts"]))
    return features.withColumn("zone", classify_zone(F.col("location_name"), ruleset))


def pca_analysis(
    readings: DataFrame, features: Sequence[str] = FEATURES, ruleset: str = "default"
) -> PcaResult:
    """Fit and score the components of station-hour rows and compare the zones.

    The feature rows are staged: the fit and every result read the pivot, not the raw lines.
    """
    spark = readings.sparkSession
    table = staged(feature_table(readings, ruleset), "features")
    model = pca.fit_pca(table, features)
    scores = pca.project(table, model)
    return PcaResult(
        model,
        scores,
        pca.loadings(spark, model),
        pca.variance(spark, model),
        pca.zone_centroids(scores),
        pca.zone_separation(scores),
        pca.kpi_pca(scores, model),
    )


def violation_analysis(
    readings: DataFrame, names: DataFrame | None, parameters: Sequence[str] = ("pm25",), **options
) -> DataFrame:
    """Heatmap of violation rates of the chosen parameters.

    Without ``names`` every reading counts once, under the location name it carries.
    """
    chosen = readings.filter(F.col("parameter").isin(list(parameters)))
    if names is None:
        return violations.violation_heatmap(chosen, station="location_name", **options)
    return violations.violation_heatmap(chosen.drop("location_name"), names=names, **options)


@dataclass(frozen=True)
class TailResult:
    kpi: DataFrame
    histogram: DataFrame
    survival: DataFrame
    tail: DataFrame
    exceedance: DataFrame


def tail_analysis(
    readings: DataFrame,
    station: str | None = None,
    parameters: Sequence[str] = ("pm25",),
    key: str = "location_name",
) -> TailResult:
    """Tail statistics of one station (by default the one with most readings).

    Curve, percentile and exceedance share one ranged sort of the station's values.
    """
    chosen = readings.filter(F.col("parameter").isin(list(parameters)))
    station = tails.busiest_station(chosen, key) if station is None else station
    own = staged(chosen.filter(F.col(key) == station).select(key, "value"), "station")
    ranks = tails.tail_ranks(own)
    curve = tails.survival_curve(own, ranks=ranks)
    return TailResult(
        tails.kpi_tail(own, key, target=station, ranks=ranks),
        tails.histogram(own),
        curve,
        tails.survival_tail(curve),
        tails.exceedance_at(own, ranks=ranks),
    )


def exposure_analysis(
    readings: DataFrame,
    names: DataFrame | None,
    density: DataFrame,
    parameters: Sequence[str] = ("pm25",),
    ruleset: str = "cased",
) -> DataFrame:
    """Mean of the chosen parameters per station with density and zone.

    Without ``names`` every reading counts once, under the location name it carries.
    """
    chosen = readings.filter(F.col("parameter").isin(list(parameters)))
    chosen = chosen if names is None else chosen.drop("location_name")
    return ex.exposure(ex.station_means(chosen, names=names), density, ruleset=ruleset)


def compare_sources(
    a: DataFrame, b: DataFrame, tolerance: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Two readings tables of the same stations, hour by hour, and the summary per outcome."""
    keys = ["station_id", "parameter", "ts"]
    named = [
        side.withColumn("parameter", normalise_parameter(F.col("parameter"), "keep"))
        for side in (a, b)
    ]
    compared = reconcile(*named, keys, tolerance=tolerance)
    return compared, reconcile_summary(compared)
