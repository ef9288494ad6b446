from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cadenza.session import get_spark

    s = get_spark("local[4]", app="cadenza-tests", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def events_small(spark):
    from cadenza.sources import fixtures

    return fixtures.plays(spark, SF_SMALL, "plays_events")


@pytest.fixture(scope="session")
def events_mid(spark):
    from cadenza.sources import fixtures

    return fixtures.plays(spark, SF_MID, "plays_events")
