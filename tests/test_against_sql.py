"""Every registered query with SQL gives the same rows in Spark and in the other engine."""

import pytest

import checks.jobs  # noqa: F401  (registers)
import checks.oracle_jobs  # noqa: F401  (registers)
from checks.compare import difference
from checks.oracle import SQL
from checks.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, small, name):
    assert difference(spark, con, name, small) is None


def test_sql_is_registered():
    assert set(SQL) <= set(REGISTRY)
    assert set(REGISTRY) - set(SQL) == set()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
