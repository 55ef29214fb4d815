"""Every registered ledger query that has SQL against DuckDB, and the shape of the others."""

import pytest
from comparing import same_rows

from countinghouse.plans import queries as plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    same_rows(plans.queries()[name](spark, sf), duck.sql(SQL[name]))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["timestamp"] for r in rows] == sorted((r["timestamp"] for r in rows), reverse=True)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
