"""Every core query against its SQL."""

import pytest

from compare import assert_equal_rows
from priorflow import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, sf, name):
    assert_equal_rows(q.QUERIES[name](spark, sf), q.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
