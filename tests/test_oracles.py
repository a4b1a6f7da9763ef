"""Every registered query against its DuckDB oracle."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from slimlake import catalog
from tests.compare import compare, duck

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_oracle(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name)) is None


def test_the_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_only_inexpressible_queries_lack_an_oracle():
    assert sorted(set(QUERIES) - set(ORACLES)) == [
        "S2_direct_listing", "V10_measured_ratios",
    ]


def test_the_entry_lists_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
