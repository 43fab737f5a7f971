"""Every registered query against its DuckDB oracle (order-insensitive value hash).

Runs on sf0.001 by default; ``ORACLE_SF=/root/testdata/sf0.01`` runs the driver's scale.
"""

import os

import pytest

from tipflow.plans.compare import compare, duck
from tipflow.plans.registry import oracle_sql, queries

from .conftest import SF_SMALL

KEYS = sorted(queries())


SF = os.environ.get("ORACLE_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF)
    sql = oracle_sql().get(key)
    if sql is None:
        df.count()
        return
    ok, msg = compare(df, con, sql)
    assert ok, msg


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())
