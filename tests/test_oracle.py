"""Every query key against its DuckDB oracle on the smallest test folder (the driver does sf0.01)."""

from __future__ import annotations

import os

import pytest
from oracle_compare import canon, duck

import __spark_entry__ as E
from clickfold.plans.catalog import QUERIES as CATALOG

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ALL, SQL = E.queries(), E.oracle_sql()
QUERIES = {key: ALL[key] for key in CATALOG}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL) <= set(ALL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["stock_status", "total_carts", "abandoned_carts", "abandonment_rate"]
    assert df.count() >= 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(SQL[key])
    exp_cols, exp = [d[0] for d in res.description], res.fetchall()
    assert sorted(got_cols) == sorted(exp_cols)
    assert len(got) == len(exp)
    assert canon(got_cols, got) == canon(exp_cols, exp)
