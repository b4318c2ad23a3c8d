"""The correctness gate: every catalogue query with an oracle must match
DuckDB on the same parquet tables (here at sf0.001)."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import oracle_check  # noqa: E402
from quire.plans.catalog import QUERIES  # noqa: E402
from quire.plans.oracle import SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_matches_oracle(spark, con, name):
    ok, info, types = oracle_check.compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert ok, info + "\n" + types


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 45
