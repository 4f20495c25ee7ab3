"""Every registered query with SQL gives the rows that DuckDB gives; every other one runs."""

import pytest

from blockloom.plans import registry
from tests.conftest import plain

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    other = duck.execute(SQL[name])
    columns = [c[0] for c in other.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*sorted(columns)).collect()) == plain([[r[columns.index(c)] for c in sorted(columns)] for r in other.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark, folder):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
