"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import oracle
import pytest
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("RISKPANEL_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())
