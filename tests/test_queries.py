import pytest

import __spark_entry__ as entry
from compare import duck_rows, spark_rows
from panewise.plans import registry

QUERIES = {name: query.run for name, query in registry.QUERIES.items()}
SQL = {name: query.sql for name, query in registry.QUERIES.items()}


def test_every_query_has_sql_and_is_an_entry():
    assert all(SQL.values())
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_small, name):
    got = spark_rows(QUERIES[name](spark, sf_small))
    assert got[1], "no rows"
    assert got == duck_rows(sf_small, SQL[name])


def test_entry(spark, sf_small):
    assert entry.entry(spark).columns == ["value"]
    assert entry.entry(spark).count() > 0
