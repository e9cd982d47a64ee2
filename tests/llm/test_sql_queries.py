"""The subpackage's queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from voxlattice.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    tidy = lambda x: None if x is None or str(x) == "<NA>" or x != x else x if isinstance(x, (bool, str)) else float(x)
    return sorted([tuple(map(tidy, r)) for r in frame[columns].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())
