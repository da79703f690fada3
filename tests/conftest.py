from __future__ import annotations

import os

import pytest

from exonloom.runtime import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not there")
    return SF


def rows(df):
    """Rows of a DataFrame as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
