"""Standardising, correlations, principal components and zone separation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from stationlake.catalog.registry import query, rounded, table
from stationlake.functions.vocabulary import classify_zone
from stationlake.operators import pca
from stationlake.sources.shared import staged

SIX = ["n_lines", "quantity", "price", "discount", "tax", "total"]
TWO = ["quantity", "price"]
ZONES = {"priority": (["urgent", "high"], False)}

_FEATURES = """
SELECT l_orderkey AS o_orderkey, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS quantity,
       sum(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax,
       any_value(o_totalprice) AS total,
       CASE WHEN contains(lower(any_value(o_orderpriority)), 'urgent')
              OR contains(lower(any_value(o_orderpriority)), 'high')
            THEN 'Industrial' ELSE 'Residential' END AS zone
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
"""


def order_features(spark, folder):
    """Six numbers per order with a zone from its priority."""
    per_order = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("total"),
        classify_zone(F.col("o_orderpriority"), "priority", ZONES).alias("zone"),
    )
    return per_order.join(orders, "o_orderkey")


def _fitted(spark, folder, features):
    """Staged features with the model fitted on them: the tables are read once."""
    rows = staged(order_features(spark, folder), "features")
    return rows, pca.fit_pca(rows, features)


_MOMENTS = f"WITH f AS ({_FEATURES})" + " UNION ALL ".join(
    f" SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM f"
    for c in SIX
)


@query(_MOMENTS)
def feature_moments(spark, folder):
    return rounded(pca.feature_moments(order_features(spark, folder), SIX), "mean", "std")


@query(f"WITH f AS ({_FEATURES}) SELECT o_orderkey, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f), 6) AS z_{c}" for c in SIX
) + " FROM f")
def standardised_features(spark, folder):
    z = pca.standardise(order_features(spark, folder), SIX)
    names = [f"z_{c}" for c in SIX]
    return rounded(z.select("o_orderkey", *names), *names)


@query(f"WITH f AS ({_FEATURES})" + " UNION ALL ".join(
    f" SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM f"
    for a, b in combinations(SIX, 2)
))
def correlation_matrix(spark, folder):
    return rounded(pca.correlation_matrix(order_features(spark, folder), SIX), "r")


# Two positively correlated features have a closed form: components (1, 1) and (1, -1) over
# the root of 2, variance shares (1 + r) / 2 and (1 - r) / 2.
@query(f"""
WITH f AS ({_FEATURES}), m AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq,
                                      avg(price) AS mp, stddev_pop(price) AS sp FROM f)
SELECT o_orderkey, round(((quantity - mq) / sq + (price - mp) / sp) / sqrt(2), 6) AS PC1,
       round(((quantity - mq) / sq - (price - mp) / sp) / sqrt(2), 6) AS PC2
FROM f CROSS JOIN m
""")
def pca2_scores(spark, folder):
    rows, model = _fitted(spark, folder, TWO)
    return rounded(pca.project(rows, model).select("o_orderkey", "PC1", "PC2"), "PC1", "PC2")


@query(f"""
WITH f AS ({_FEATURES}), r AS (SELECT corr(quantity, price) AS r FROM f)
SELECT 'PC1' AS component, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cumulative FROM r
UNION ALL SELECT 'PC2', round((1 - r) / 2, 6), 1.0::DOUBLE FROM r
""")
def pca2_variance(spark, folder):
    _, model = _fitted(spark, folder, TWO)
    return rounded(pca.variance(spark, model), "ratio", "cumulative")


def component_sql(
    select: str, rows: str = _FEATURES, names: list[str] = SIX, key: str = "o_orderkey"
) -> str:
    """Six features: eigenvectors by squaring the correlation matrix until one direction is left.

    ``e1`` and ``e2`` hold the unit vectors ``v`` (largest loading positive) and eigenvalues
    ``l``; the second comes from the matrix with the first taken out.
    """
    cell = lambda a, b: "1.0::DOUBLE" if a == b else f"corr({a}, {b})"
    matrix = "[" + ", ".join("[" + ", ".join(cell(a, b) for b in names) + "]" for a in names) + "]"

    def squared(name: str, source: str) -> str:
        trace = " + ".join(f"a[{i}][{i}]" for i in range(1, 7))
        return f"""
{name}_s(i, a) AS (
  SELECT 0, a FROM {source}
  UNION ALL
  SELECT i + 1, list_transform(b, lambda r: list_transform(r, lambda x: x / t)) FROM (
    SELECT i, a AS b0, list_transform(a, lambda r: list_transform(a, lambda q: list_dot_product(r, q))) AS b,
           list_sum(list_transform(a, lambda r: list_dot_product(r, r))) AS t FROM {name}_s WHERE i < 16)),
{name}_p AS (SELECT a, list_transform(a, lambda r, k: r[k]) AS d FROM {name}_s WHERE i = 16),
{name}_q AS (SELECT a[list_position(d, list_max(d))] AS u FROM {name}_p),
{name}_n AS (SELECT list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS v FROM {name}_q),
{name}_o AS (SELECT v, list_transform(v, lambda x: abs(x)) AS w FROM {name}_n),
{name}_v AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(w, list_max(w))])) AS v FROM {name}_o),
{name} AS (SELECT v, list_dot_product(v, list_transform(c.a, lambda r: list_dot_product(r, v))) AS l
           FROM {name}_v CROSS JOIN corr_matrix c)"""

    z = [f"((f.{c} - m.m_{c}) / m.s_{c})" for c in names]
    score = lambda e: " + ".join(f"{z[i]} * {e}.v[{i + 1}]" for i in range(6))
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in names)
    return f"""
WITH RECURSIVE f AS ({rows}),
corr_matrix AS (SELECT {matrix} AS a FROM f),
{squared("e1", "corr_matrix")},
rest AS (SELECT list_transform(c.a, lambda r, k: list_transform(r, lambda x, n: x - e1.l * e1.v[k] * e1.v[n])) AS a
         FROM corr_matrix c CROSS JOIN e1),
{squared("e2", "rest")},
m AS (SELECT {moments} FROM f),
scores AS (SELECT {key}, zone, {score("e1")} AS PC1, {score("e2")} AS PC2
           FROM f CROSS JOIN m CROSS JOIN e1 CROSS JOIN e2)
{select}
"""


@query(component_sql("SELECT o_orderkey, zone, round(PC1, 6) AS PC1, round(PC2, 6) AS PC2 FROM scores"))
def pca6_scores(spark, folder):
    rows, model = _fitted(spark, folder, SIX)
    scores = pca.project(rows, model).select("o_orderkey", "zone", "PC1", "PC2")
    return rounded(scores, "PC1", "PC2")


@query(component_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(e1.v[{i}], 6) AS PC1, round(e2.v[{i}], 6) AS PC2 FROM e1 CROSS JOIN e2"
    for i, c in enumerate(SIX, 1)
)))
def pca6_loadings(spark, folder):
    _, model = _fitted(spark, folder, SIX)
    return rounded(pca.loadings(spark, model), "PC1", "PC2")


@query(component_sql("""
SELECT 'PC1' AS component, round(e1.l / 6, 6) AS ratio, round(e1.l / 6, 6) AS cumulative FROM e1
UNION ALL SELECT 'PC2', round(e2.l / 6, 6), round((e1.l + e2.l) / 6, 6) FROM e1 CROSS JOIN e2
"""))
def pca6_variance(spark, folder):
    _, model = _fitted(spark, folder, SIX)
    return rounded(pca.variance(spark, model), "ratio", "cumulative")


@query(component_sql("""
SELECT zone, round(avg(PC1), 6) AS pc1, round(avg(PC2), 6) AS pc2, count(*) AS n FROM scores GROUP BY 1
"""))
def zone_centroids(spark, folder):
    rows, model = _fitted(spark, folder, SIX)
    return rounded(pca.zone_centroids(pca.project(rows, model)), "pc1", "pc2")


_MEANS = """
SELECT avg(PC1) FILTER (WHERE zone = 'Residential') AS res_pc1, avg(PC2) FILTER (WHERE zone = 'Residential') AS res_pc2,
       avg(PC1) FILTER (WHERE zone = 'Industrial') AS ind_pc1, avg(PC2) FILTER (WHERE zone = 'Industrial') AS ind_pc2
FROM scores
"""


@query(component_sql(f"""
SELECT round(res_pc1, 6) AS res_pc1, round(res_pc2, 6) AS res_pc2, round(ind_pc1, 6) AS ind_pc1,
       round(ind_pc2, 6) AS ind_pc2, round(sqrt(power(ind_pc1 - res_pc1, 2) + power(ind_pc2 - res_pc2, 2)), 6) AS centroid_gap,
       round(ind_pc1 - res_pc1, 6) AS pc1_difference
FROM ({_MEANS})
"""))
def zone_separation(spark, folder):
    rows, model = _fitted(spark, folder, SIX)
    result = pca.zone_separation(pca.project(rows, model))
    return rounded(result, *result.columns)


@query(component_sql(f"""
SELECT (SELECT count(*) FROM scores) AS records, round((e1.l + e2.l) / 6, 6) AS variance_captured,
       round(e1.l / 6, 6) AS pc1_variance, round(e2.l / 6, 6) AS pc2_variance,
       round(sqrt(power(ind_pc1 - res_pc1, 2) + power(ind_pc2 - res_pc2, 2)), 6) AS centroid_gap
FROM ({_MEANS}) CROSS JOIN e1 CROSS JOIN e2
"""))
def kpi_pca(spark, folder):
    rows, model = _fitted(spark, folder, SIX)
    cards = pca.kpi_pca(pca.project(rows, model), model)
    return rounded(cards, "variance_captured", "pc1_variance", "pc2_variance", "centroid_gap")
