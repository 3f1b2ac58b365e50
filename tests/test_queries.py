"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from stationlake.catalog import ORACLES, QUERIES
from tests import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not supplied")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem, n = compare.difference(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None
    assert n > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns[0] == "label"
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("partitions", ["1", "13"])
@pytest.mark.parametrize("name", ["survival_curve_by_station", "violation_heatmap", "timeline_rebuild", "scan_order"])
def test_partition_count_changes_nothing(spark, con, conf, name, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    conf("spark.sql.adaptive.enabled", "false")
    problem, _ = compare.difference(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None


@pytest.mark.parametrize("name", ["survival_curve_by_station", "exposure", "violation_heatmap", "new_series", "scan_order"])
def test_results_without_any_broadcast(spark, con, conf, name):
    """The way beyond the broadcast threshold gives the same rows."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    problem, _ = compare.difference(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None
