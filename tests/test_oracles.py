"""Every query of the plans against DuckDB, on the smallest tables."""

import pytest
from oracle import SMALL, duck_rows, spark_rows

from storyloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(SMALL, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
