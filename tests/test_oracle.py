"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import check_oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return check_oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    status, rows, detail = check_oracle.compare(spark, duck, QUERIES[name], SQL.get(name), sf)
    assert status in ("ok", "rows-only"), detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0
