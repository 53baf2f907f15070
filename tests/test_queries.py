"""Registered queries against their SQL at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, canon

# The training-data operators have tests of their own.
ORACLES = entry._REGISTRY.ORACLES
QUERIES = {name: fn for name, fn in entry.queries().items() if name in entry._REGISTRY.QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    r = duck.sql(ORACLES[name])
    assert got == canon(r.fetchall(), r.columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
