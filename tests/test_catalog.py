"""Every registered query at the smallest scale, against DuckDB where it has SQL."""

import pytest
from compare import duck, kinds, table_of

from alertlake.plans.catalog import load_all

FOLDER = "/root/testdata/sf0.001"
CATALOG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    q = CATALOG[name]
    df = q.build(spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        assert got
        return
    cursor = con.execute(q.sql)
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert table_of(df.columns, got) == table_of(columns, want)
    assert kinds(df.columns, got) == kinds(columns, want)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["type", "severity", "count", "threshold", "details"]
