"""Principal components of standardised features, and the separation of zones.

The fit reads the rows once: means, deviations and covariances of all feature pairs
come from one aggregate. Only that one row (its size is the square of the number of
features) reaches the driver, where the small eigenproblem is solved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.vocabulary import FEATURES, ZONE_MATCH, ZONE_OTHER


@dataclass(frozen=True)
class PcaModel:
    """Fitted components: ``weights[j][i]`` is the loading of feature i on component j."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[list[float]]
    ratios: list[float]
    n: int


def feature_moments(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, mean, std) with the population deviation, from one aggregate."""
    moments = df.agg(*[
        a.alias(f"{kind}_{f}")
        for f in features
        for kind, a in (("m", F.avg(f)), ("s", F.stddev_pop(f)))
    ])
    return moments.select(F.inline(F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std")
        )
        for f in features
    ])))


def standardise(df: DataFrame, features: Sequence[str] = FEATURES, prefix: str = "z_") -> DataFrame:
    """Add (x - mean) / population deviation per feature; a constant feature becomes 0."""
    moments = df.agg(*[
        F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features
    ])
    stats = moments.select(F.struct(*features).alias("_moments")).scalar()
    with_stats = df.withColumn("_moments", stats)
    scaled = with_stats.withColumns({
        f"{prefix}{f}": (F.col(f) - F.col(f"_moments.{f}.mean"))
        / _scale(F.col(f"_moments.{f}.std"))
        for f in features
    })
    return scaled.drop("_moments")


def _scale(std: Column) -> Column:
    return F.when(std == 0, 1.0).otherwise(std)


def correlation_matrix(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature_a, feature_b, r) for every pair a before b, from one aggregate."""
    pairs = list(combinations(features, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])))


def fit_pca(df: DataFrame, features: Sequence[str] = FEATURES, k: int = 2) -> PcaModel:
    """Fit ``k`` components on complete rows; the largest loading of each is positive."""
    features = list(features)
    complete = df.dropna(how="any", subset=features)
    pairs = list(combinations(range(len(features)), 2))
    row = complete.agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)],
        *[F.covar_pop(features[i], features[j]).alias(f"c_{i}_{j}") for i, j in pairs],
    ).first()
    if row["n"] == 0:
        raise ValueError("no complete rows to fit on")
    deviations = [row[f"s_{i}"] for i in range(len(features))]
    scales = [s if s > 0 else 1.0 for s in deviations]
    matrix = np.diag([1.0 if s > 0 else 0.0 for s in deviations])
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"c_{i}_{j}"] / (scales[i] * scales[j])
    spread, vectors = np.linalg.eigh(matrix)
    order = np.argsort(spread)[::-1][:k]
    weights = []
    for column in vectors[:, order].T:
        # The first of equally large loadings decides the sign.
        largest = int(np.argmax(np.round(np.abs(column), 9)))
        weights.append((column * np.sign(column[largest])).tolist())
    total = float(spread.sum())
    ratios = [float(spread[j] / total) if total > 0 else 0.0 for j in order]
    means = [row[f"m_{i}"] for i in range(len(features))]
    return PcaModel(features, means, scales, weights, ratios, row["n"])


def project(df: DataFrame, model: PcaModel) -> DataFrame:
    """Add PC1..PCk to every complete row, as plain column arithmetic."""
    complete = df.dropna(how="any", subset=model.features)
    scaled = [
        (F.col(f) - F.lit(m)) / F.lit(s)
        for f, m, s in zip(model.features, model.means, model.scales)
    ]
    return complete.withColumns({
        f"PC{j}": reduce(lambda a, b: a + b, [z * F.lit(w) for z, w in zip(scaled, component)])
        for j, component in enumerate(model.weights, 1)
    })


def loadings(spark: SparkSession, model: PcaModel) -> DataFrame:
    """(feature, PC1..PCk)."""
    names = [f"PC{j}" for j in range(1, len(model.weights) + 1)]
    rows = [(f, *[w[i] for w in model.weights]) for i, f in enumerate(model.features)]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in names))


def variance(spark: SparkSession, model: PcaModel) -> DataFrame:
    """(component, ratio, cumulative)."""
    rows = [
        (f"PC{j}", ratio, float(sum(model.ratios[:j]))) for j, ratio in enumerate(model.ratios, 1)
    ]
    return spark.createDataFrame(rows, "component string, ratio double, cumulative double")


def zone_centroids(scores: DataFrame, zone: str = "zone") -> DataFrame:
    """Mean scores and size of each zone."""
    return scores.groupBy(zone).agg(
        F.avg("PC1").alias("pc1"), F.avg("PC2").alias("pc2"), F.count("*").alias("n")
    )


def zone_separation(
    scores: DataFrame, zone: str = "zone", match: str = ZONE_MATCH, other: str = ZONE_OTHER
) -> DataFrame:
    """One row: both centroids, their distance and the PC1 difference (NULL if a zone is empty)."""
    means = scores.agg(*[
        F.avg(F.when(F.col(zone) == z, F.col(pc))).alias(f"{short}_{pc.lower()}")
        for short, z in (("res", other), ("ind", match))
        for pc in ("PC1", "PC2")
    ])
    d1, d2 = F.col("ind_pc1") - F.col("res_pc1"), F.col("ind_pc2") - F.col("res_pc2")
    return means.withColumns({"centroid_gap": F.sqrt(d1 * d1 + d2 * d2), "pc1_difference": d1})


def kpi_pca(scores: DataFrame, model: PcaModel, zone: str = "zone") -> DataFrame:
    """One row for the metric cards: records, variance captured, PC1, PC2, centroid gap."""
    return zone_separation(scores, zone).select(
        F.lit(model.n).cast("long").alias("records"),
        F.lit(float(sum(model.ratios[:2]))).alias("variance_captured"),
        F.lit(model.ratios[0]).alias("pc1_variance"),
        F.lit(model.ratios[1]).alias("pc2_variance"),
        "centroid_gap",
    )
