"""Every query that has SQL, against DuckDB on the smallest tables; the others must return rows."""

import os

import duckdb
import pytest

from voxlattice.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(frame):
    def value(x):
        if x is None or str(x) == "<NA>" or x != x:
            return None
        return x if isinstance(x, (bool, str)) else float(x) if hasattr(x, "__float__") else str(x)

    columns = sorted(frame.columns)
    return columns, sorted([tuple(map(value, row)) for row in frame[columns].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    (columns, rows), (wanted, expected) = plain(found), plain(duck.sql(sql).df())
    assert columns == wanted
    assert len(rows) == len(expected)
    for row, other in zip(rows, expected, strict=True):
        assert row == pytest.approx(other, abs=2e-6)
