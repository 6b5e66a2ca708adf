"""Every catalogue query against its SQL in DuckDB."""

import pytest
from oracle import difference, duck

from sparkwave import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    if name in SQL:
        assert difference(rows, SQL[name], duck(sf)) == ""
    else:
        assert rows.count() > 0


def test_only_noise_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"simulate_noisy"}


def test_entry_registers_the_catalogue(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
