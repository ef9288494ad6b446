"""Every registered query with an oracle equals its DuckDB twin (sf0.001)."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from oracle_check import digest, duck

import __spark_entry__ as E
from cadenza.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "impatience_score_pct" in df.columns
