"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from compare import both, tables

from hopmill.plans import PLANS

SF = "/root/testdata/sf0.001"
QUERIES = {k: (q, p.SQL.get(k)) for p in PLANS for k, q in p.QUERIES.items()}


@pytest.fixture(scope="module")
def db():
    return tables(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, SF).count() > 0
        return
    got, want = both(spark, db, query, sql, SF)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
