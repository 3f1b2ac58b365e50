from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stationlake.session import get_session

    session = get_session(
        "stationlake-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "6",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set runtime settings for one test."""
    before = {}

    def set_to(key, setting):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, setting)

    yield set_to
    for key, old in before.items():
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def rows(df, *order):
    """Rows as plain tuples, ordered."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
