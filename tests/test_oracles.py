"""Every registered query against its SQL, on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from catalog import all_oracles, all_queries
from tests.compare import DATA, connect, differences

SF_DIR = f"{DATA}/sf0.01"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, db, name):
    assert differences(QUERIES[name](spark, SF_DIR), db, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_on_the_smallest_tables(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["station", "date"]
