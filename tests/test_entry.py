import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from meterloom.operators import learn
from meterloom.plans import queries

TABLES = "orders lineitem events".split()
QUERIES = entry_point.queries()
ORACLE = entry_point.oracle_sql()
# Those of the optional subpackage have tests of their own beside it.
OWN = [name for name in QUERIES if name.startswith("operational") or name != "pipeline" and not name.startswith("op")]
# Series need more than a year of complete rows, which the smallest tables don't have.
LONG = "/root/testdata/sf0.01"
# Full-length ensembles take minutes; here they are short, and so is the recursion.
ENSEMBLES = {"forest_forecast", "gbt_forecast", "importance_top", "operational_metrics", "recursive_forecast", "recursive_metrics"}
MODELS = {"ridge_forecast", "ridge_coefficients", "ridge_residual_check"}
# With SQL, but without rows on the smallest tables.
LONG_ORACLE = {"boosting_rules", "forest_rules", "holt_winters", "sarima_weights_check", "recursive_ridge_given", "holt_winters_given", "sarima_given"}


@pytest.fixture(scope="module")
def engine(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)

    def cell(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)[:10] if hasattr(v, "isoformat") and str(v).endswith("00:00:00") else str(v)

    return sorted("|".join(map(cell, r)) for r in frame.values.tolist())


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def compare(spark, engine, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = engine.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)


@pytest.mark.parametrize("name", sorted((set(ORACLE) & set(OWN)) - ENSEMBLES - MODELS - LONG_ORACLE))
def test_query_equals_sql(spark, engine, folder, name):
    compare(spark, engine, folder, name)


@pytest.mark.parametrize("name", sorted(LONG_ORACLE))
def test_query_equals_sql_on_longer_series(spark, name):
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"create view {table} as select * from '{LONG}/{table}.parquet'")
    assert compare(spark, engine, LONG, name) > 0


@pytest.mark.parametrize("name", sorted(set(OWN) - set(ORACLE) - ENSEMBLES | MODELS))
def test_model_query_runs(spark, name):
    assert QUERIES[name](spark, LONG).count() > 0


@pytest.mark.parametrize("name", sorted(ENSEMBLES))
def test_ensemble_query_runs(spark, monkeypatch, name):
    monkeypatch.setitem(learn.FOREST, "numTrees", 3)
    monkeypatch.setitem(learn.BOOSTING, "maxIter", 3)
    monkeypatch.setattr(queries, "TEST_END", "2000-01-12")
    assert QUERIES[name](spark, LONG).count() > 0


def test_ridge_meets_its_normal_equations(spark):
    assert {r.distance for r in QUERIES["ridge_residual_check"](spark, LONG).collect()} == {0.0}


def test_all_is_tested():
    assert ENSEMBLES | MODELS | LONG_ORACLE <= set(OWN)
