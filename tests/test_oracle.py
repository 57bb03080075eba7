"""Every query of the engine with SQL gives the SQL's rows."""

import pytest

from canopyloom.plans import queries as q
from tests.oracle import normal, rows_of


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    got, want = q.QUERIES[name](spark, small).toPandas(), rows_of(q.ORACLE_SQL[name], small)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL) - {"prune_exact", "prune_apply"}))
def test_query_without_sql_has_rows(spark, small, name):
    assert q.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
