"""Every query of the process-health operators against SQL over the same tables."""

import pytest
from oracle import rows_of, spark_rows

from tidemark.queries import oracle_sql, queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    names, want = rows_of(SQL[name], sf)
    got_names, got = spark_rows(queries()[name](spark, sf))
    assert got_names == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
