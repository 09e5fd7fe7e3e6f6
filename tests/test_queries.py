"""Every registered query with SQL gives what DuckDB gives; the rest give rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    outcome, _ = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert outcome.startswith(("ok", "rows-only")) and "TYPES" not in outcome, outcome


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    best = entry(spark).where("rank = 1").head()
    assert (best["column_a"], best["column_b"]) == ("o_custkey", "c_custkey")
