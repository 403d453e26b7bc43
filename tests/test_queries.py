"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest

from recallkit import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, same):
    same(q.queries()[name](spark, sf_dir), q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert q.queries()[name](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
