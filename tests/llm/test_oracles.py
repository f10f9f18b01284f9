"""Every query of the subpackage against its SQL on the same tables, as an outside check would compare them."""

import duckdb
import pytest
from meterloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def engine(folder):
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, engine, folder, name):
    got = QUERIES[name](spark, folder)
    want = engine.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)
