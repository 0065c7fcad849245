"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture
def stored_plans(spark, monkeypatch):
    """The plans of all frames that are written while a query is built."""
    frame, plans = type(spark.range(1)), []
    write = frame.write.fget

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(frame, "write", property(noted))
    return plans


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name, stored_plans):
    df = QUERIES[name](spark, data)
    for plan in [*stored_plans, df._jdf.queryExecution().executedPlan().toString()]:
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert differences(df, data, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).head(1)


def test_entry(spark, data):
    assert entry.entry(spark).head(1)
