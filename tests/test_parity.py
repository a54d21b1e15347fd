"""Every registered query with an SQL counterpart gives the same rows as that counterpart."""

import os

import pytest

import __spark_entry__
from phylolake.plans import catalogue
from tests import parity

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert parity.compare(QUERIES[name](spark, SF), con, ORACLE[name]) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_every_query_is_registered_once():
    every = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(every)
    assert set(QUERIES) <= set(every)
