"""What model fits and recursions cost: plans, passes and memory that don't grow with rounds, days or layout."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import functions as F

from meterloom.operators import learn, recursive
from meterloom.operators.learn import assemble
from meterloom.session import cut_lineage


@pytest.fixture(scope="module")
def train(spark):
    first = dt.date(2018, 1, 1)
    rows = [(k, first + dt.timedelta(i), float(i % 7), float((i * 37) % 101), (i % 7) * 3.0 + (i * 37) % 11 + n) for n, k in enumerate("ab") for i in range(400)]
    return cut_lineage(spark.createDataFrame(rows, "k string, date date, a double, b double, y double"))


def test_a_forest_holds_few_histograms_and_grows_the_same_trees(train, monkeypatch):
    matrix = cut_lineage(learn.tree_matrix(learn.Fitted("y", ["a", "b"], ["k"]), train))
    model = learn.forest(matrix, "y", numTrees=4, maxDepth=6)
    assert model.getMaxMemoryInMB() <= 128
    monkeypatch.setattr(learn, "HISTOGRAM_MB", 1024)
    assert [t.toDebugString.split("\n")[1:] for t in learn.forest(matrix, "y", numTrees=4, maxDepth=6).trees] == [
        t.toDebugString.split("\n")[1:] for t in model.trees]


def test_a_forest_depends_on_rows_and_not_on_their_layout(train):
    grown = []
    for stored in (train.coalesce(1).orderBy("date", "k"), train.repartition(7)):
        matrix = learn.tree_matrix(learn.Fitted("y", ["a", "b"], ["k"]), stored)
        model = learn.forest(cut_lineage(matrix), "y", numTrees=3, maxDepth=4)
        grown.append([[line for line in t.toDebugString.split("\n")[1:] if "Predict" not in line] for t in model.trees])
    assert grown[0] == grown[1]


def test_rows_are_cut_into_few_training_tasks(train, monkeypatch):
    parts = lambda: learn.tree_matrix(learn.Fitted("y", ["a", "b"], ["k"]), train).rdd.getNumPartitions()
    assert parts() == 1
    monkeypatch.setattr(learn, "ROWS_A_TASK", 10)
    assert parts() == learn.MOST_SMALL_TASKS
    monkeypatch.setattr(learn, "ROWS_A_LARGE_TASK", 100)
    assert parts() == 8


def test_the_plan_of_a_boosting_round_does_not_grow(train, monkeypatch):
    rows = cut_lineage(assemble(train, ["a", "b"]).select("features", "y"))
    sizes, fit = [], DecisionTreeRegressor.fit

    def seen(self, dataset, *rest):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            dataset.explain(True)
        sizes.append(plan.getvalue().split("== Optimized")[0].count("UDF("))
        return fit(self, dataset, *rest)

    monkeypatch.setattr(DecisionTreeRegressor, "fit", seen)
    model = learn.boosted(rows, "y", maxIter=9)
    assert model.getNumTrees == 10 and sizes[2] == sizes[-1]


def test_tree_recursion_needs_far_fewer_passes_than_days(spark, train, monkeypatch):
    passes, apply = [], GBTRegressionModel.transform
    monkeypatch.setattr(GBTRegressionModel, "transform", lambda self, *a: passes.append(1) or apply(self, *a))
    columns = ["lag_7", "rolling_7_mean", "b"]
    matrix = cut_lineage(assemble(train.withColumns({"lag_7": F.col("a"), "rolling_7_mean": F.col("b")}), columns).select("features", "y"))
    model = learn.boosted(matrix, "y", maxIter=3)
    known = spark.createDataFrame([("a", 40), ("b", 25), (None, 30)], "k string, n int").select(
        "k", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.array(F.lit(None).cast("double"), F.lit(None), i * 2.0).alias("known"))).alias("_days"),
        F.transform(F.sequence(F.lit(1), F.col("n") % 9 + 1), lambda i: i * 1.5).alias("_history"), F.array(*[F.lit(float(v)) for v in (1, 2, 3)]).alias("_fill"))
    passes.clear()
    got = {r.k: r for r in recursive.tree_recursion(known, columns, model, ["k"]).collect()}
    assert {k: len(r._made) for k, r in got.items()} == {"a": 40, "b": 25, None: 30}
    assert 0 < len(passes) <= 20
    for r in got.values():  # day by day
        past = list(r._history)
        for i, made in enumerate(r._made):
            recent = past[-7:]
            x = [past[-7] if len(past) >= 7 else 1.0, sum(recent) / len(recent) if len(recent) >= 3 else 2.0, (i + 1) * 2.0]
            past.append(model.predict(Vectors.dense(x)))
            assert made == past[-1]
