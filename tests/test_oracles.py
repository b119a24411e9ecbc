"""Every query with SQL agrees with DuckDB on the small tables."""

import pytest
from compare import connection, rows

from tidemark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    found, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark, sf_dir):
    import __spark_entry__ as spec

    assert spec.entry(spark).count() > 0
    assert set(spec.oracle_sql()) <= set(spec.queries())
