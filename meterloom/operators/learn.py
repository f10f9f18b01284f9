"""Feature models evaluated one day ahead: ridge, random forest and gradient boosting."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators import evaluate, features
from meterloom.operators.daily import coerce_numeric, time_split
from meterloom.operators.regression import coefficient_table, predict_linear, ridge
from meterloom.operators.series import Keys, attach
from meterloom.session import cut_lineage, shared_folder

# Model names and their default settings.
MODELS = ["ridge", "random_forest", "gradient_boosting"]
RIDGE_ALPHA = 1.0
FOREST = {"numTrees": 250, "maxDepth": 10, "minInstancesPerNode": 5, "seed": 42}
BOOSTING = {"maxIter": 250, "stepSize": 0.05, "maxDepth": 3, "minInstancesPerNode": 5, "seed": 42}

# Own choice: boosting rounds between two writes of the residuals.
ROUNDS_A_WRITE = 10

# Own choice: rows of a training task. A forest's task sends a histogram of every node it works on, whatever its rows, so
# few tasks share a small table and large tables are cut into large pieces.
ROWS_A_TASK, MOST_SMALL_TASKS, ROWS_A_LARGE_TASK = 1_500, 5, 50_000

# Own choice: megabytes of histograms that a task of a forest holds at a time. More are done in further passes over the same
# splits, so the trees are the same.
HISTOGRAM_MB = 128


# Own choice: name of the input that tells series apart.
SERIES_CODE = "series_code"


@dataclass
class Fitted:
    """Models of one panel: a ridge table (one row per series) and tree models shared by all series.

    Trees see target and history in units of their series (``scales``: mean, deviation and a code per series), so
    series of unlike level share a model without being mixed up.
    """

    target: str
    columns: list[str]
    keys: list[str]
    ridge: DataFrame | None = None
    trees: dict[str, object] = field(default_factory=dict)
    scales: DataFrame | None = None

    @property
    def tree_columns(self) -> list[str]:
        return [*self.columns, *([SERIES_CODE] if self.keys else [])]


def is_history(column: str) -> bool:
    """Inputs in units of the target."""
    return features.availability_class(column) in ("target lag", "rolling target history")


def series_scales(train: DataFrame, target: str, keys: Keys) -> DataFrame:
    """Training mean and deviation of each series (one where it never varies), and a code from its name."""
    y = F.col(target).cast("double")
    code = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(1 << 20)).cast("double")
    return train.groupBy(*keys).agg(F.avg(y).alias("_mu"), F.coalesce(F.nullif(F.stddev_pop(y), F.lit(0.0)), F.lit(1.0)).alias("_sd")).withColumn(
        SERIES_CODE, code)


def scaled_inputs(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Rows with history, and the target if it is there, in units of their series. Without keys nothing changes."""
    if not fitted.keys:
        return df
    unit = lambda c: (F.col(c).cast("double") - F.col("_mu")) / F.col("_sd")
    history = [c for c in fitted.columns if is_history(c)]
    return attach(df, fitted.scales, fitted.keys).withColumns({c: unit(c) for c in [*history, *([fitted.target] if fitted.target in df.columns else [])]})


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    numeric = df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in columns})
    vector = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="features")
    return vector.transform(numeric).drop(*[f"_x_{c}" for c in columns])


def forest(matrix: DataFrame, label: str, **settings) -> RandomForestRegressionModel:
    """Random forest under the default settings; ``settings`` override single values."""
    estimator = RandomForestRegressor(
        labelCol=label, featureSubsetStrategy="all", maxBins=256, maxMemoryInMB=HISTOGRAM_MB, **{**FOREST, **settings})
    return estimator.fit(matrix)


def summed(trees: list, weights: list[float], spark: SparkSession) -> GBTRegressionModel:
    """Fitted trees as one model whose forecast is their weighted sum."""
    regression = spark._jvm.org.apache.spark.ml.regression
    gateway = spark.sparkContext._gateway
    members = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(spark._jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        members[i], shares[i] = tree._java_obj, weight
    return GBTRegressionModel(regression.GBTRegressionModel("boosted", members, shares))


def boosted(matrix: DataFrame, label: str, **settings) -> GBTRegressionModel:
    """Boosted trees that start from the mean of the labels, every tree added with the same weight.

    One single Spark tree per round is fitted to what is left of the labels. The start is a tree without a split, whose
    value is the mean; all trees together are one model of Spark's own kind, so it is applied, inspected and saved like
    any other. Residuals are written every ``ROUNDS_A_WRITE`` rounds; in between, the trees since then are applied as one
    model to the rows written last, so a round's plan is as short as the first one's.
    """
    chosen = {**BOOSTING, **settings}
    rate, rounds = chosen.pop("stepSize"), chosen.pop("maxIter")
    spark = matrix.sparkSession
    start = DecisionTreeRegressor(labelCol=label, maxDepth=0).fit(matrix)
    trees, parts = [start], matrix.rdd.getNumPartitions()
    rest = start.setPredictionCol("_tree").transform(matrix).select("features", (F.col(label) - F.col("_tree")).alias("_rest"))
    estimator = DecisionTreeRegressor(labelCol="_rest", predictionCol="_tree", maxBins=256, **chosen)
    held = None
    for done in range(rounds):
        if done % ROUNDS_A_WRITE == 0:
            written = cut_lineage(rest).coalesce(parts).persist()  # a fit reads its rows several times
            if held is not None:
                held.unpersist()
            held = rest = written
        trees.append(estimator.fit(rest))
        since = trees[done - done % ROUNDS_A_WRITE + 1:]
        rest = summed(since, [rate] * len(since), spark).setPredictionCol("_trees").transform(held).select(
            "features", (F.col("_rest") - F.col("_trees")).alias("_rest"))
    if held is not None:
        held.unpersist()
    return summed(trees, [1.0] + [rate] * rounds, spark)


def boosting_checks(model: GBTRegressionModel, matrix: DataFrame, label: str, tolerance: float = 1e-6) -> DataFrame:
    """Two rules that a boosted model must keep on its training rows, with rows checked and rows that break them.

    ``leaf means``: in every round, the value of a leaf is the mean of what was left of the labels of its rows.
    ``sum of trees``: the forecast is the start plus the weighted values of all trees.
    """
    every = []
    rows = matrix.withColumn("_rest", F.col(label)).withColumn("_sum", F.lit(0.0))
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        rows = tree.setPredictionCol(f"_p{i}").setLeafCol(f"_l{i}").transform(rows)
        every.append(F.struct(F.lit(i).alias("round"), F.col(f"_l{i}").alias("leaf"), F.col(f"_p{i}").alias("value"), F.col("_rest").alias("rest")))
        rows = rows.withColumn(f"_e{i}", every[-1]).withColumn("_rest", F.col("_rest") - weight * F.col(f"_p{i}")).withColumn(
            "_sum", F.col("_sum") + weight * F.col(f"_p{i}")).drop(f"_p{i}", f"_l{i}")
    applied = model.setPredictionCol("_whole").transform(rows)
    stored = cut_lineage(applied.select(F.array(*[f"_e{i}" for i in range(len(every))]).alias("_rounds"), "_sum", "_whole"))
    leaves = stored.select(F.explode("_rounds").alias("e")).groupBy("e.round", "e.leaf").agg(
        F.count(F.lit(1)).alias("n"), F.avg("e.rest").alias("mean"), F.max("e.value").alias("value"))
    off = lambda a, b: F.abs(a - b) > tolerance * F.greatest(F.abs(b), F.lit(1.0))
    means = leaves.agg(F.sum("n").alias("rows"), F.sum(F.when(off(F.col("mean"), F.col("value")), F.col("n")).otherwise(0)).alias("mismatches"))
    sums = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(off(F.col("_sum"), F.col("_whole"))).alias("mismatches"))
    return means.select(F.lit("leaf means").alias("rule"), "rows", "mismatches").unionByName(
        sums.select(F.lit("sum of trees").alias("rule"), "rows", "mismatches"))


def forest_checks(model: RandomForestRegressionModel, matrix: DataFrame, label: str, tolerance: float = 1e-9) -> DataFrame:
    """Two rules that a forest must keep on its training rows, with rows checked and rows that break them.

    ``mean of trees``: the forecast is the mean of the values of all trees. ``label range``: and, made of means of labels, it
    lies between the smallest and the largest label.
    """
    rows = matrix.withColumn("_sum", F.lit(0.0))
    for tree in model.trees:
        rows = tree.setPredictionCol("_tree").transform(rows).withColumn("_sum", F.col("_sum") + F.col("_tree")).drop("_tree")
    stored = cut_lineage(model.setPredictionCol("_whole").transform(rows).select("_sum", "_whole", label))
    ends = stored.agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
    every, near = attach(stored, ends, []), tolerance * F.greatest(F.abs("_whole"), F.lit(1.0))
    off = {"mean of trees": F.abs(F.col("_sum") / len(model.trees) - F.col("_whole")) > near,
           "label range": (F.col("_whole") < F.col("_low") - near) | (F.col("_whole") > F.col("_high") + near)}
    counted = every.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(k) for k, v in off.items()])
    return counted.unpivot(["rows"], list(off), "rule", "mismatches").select("rule", "rows", "mismatches")


FITS = {"random_forest": (forest, RandomForestRegressionModel), "gradient_boosting": (boosted, GBTRegressionModel)}


def tree_model(name: str, matrix: DataFrame, label: str, store: bool = False, **settings):
    """Fit a tree model; with ``store`` look it up in the shared folder first, under a mark of its training rows.

    The mark is made of all rows and settings, so other rows or settings are another model.
    """
    if name not in FITS:
        raise ValueError(f"unknown tree model {name}")
    fit, kind = FITS[name]
    if not store:
        return fit(matrix, label, **settings)
    spark = matrix.sparkSession
    seen = matrix.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct("features", label))).cast("decimal(38,0)"))).first()
    mark = hashlib.sha256(repr((name, tuple(seen), sorted(settings.items()))).encode()).hexdigest()[:32]
    path = f"{shared_folder(spark)}/model-{mark}"
    try:
        return kind.load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        model = fit(matrix, label, **settings)
        model.write().overwrite().save(path)
        return model


def tree_matrix(fitted: Fitted, train: DataFrame) -> DataFrame:
    """Vectors and labels that trees are fitted to, with the scales of the series filled in.

    Rows are dealt and ordered by series and day, so a forest's random draws don't depend on how the table was stored.
    """
    if fitted.keys and fitted.scales is None:
        fitted.scales = cut_lineage(series_scales(train, fitted.target, fitted.keys))
    rows, place = train.count(), [*fitted.keys, "date"]
    parts = max(1, min(-(-rows // ROWS_A_TASK), MOST_SMALL_TASKS), -(-rows // ROWS_A_LARGE_TASK))
    dealt = scaled_inputs(train, fitted).repartition(parts, *place).sortWithinPartitions(*place)
    return assemble(dealt, fitted.tree_columns).select("features", F.col(fitted.target).cast("double").alias(fitted.target))


def fit_models(
    train: DataFrame, target: str, columns: list[str], keys: Keys = (),
    models: list[str] | None = None, settings: dict[str, dict] | None = None, store: bool = False,
) -> Fitted:
    """Fit the listed models on complete rows: ridge per series, trees over all of them.

    The training table has one row per series and day and is written once for all tree models. These are fitted side by
    side, because each starts many small jobs that leave most cores idle. ``store``: see :func:`tree_model`.
    """
    chosen, settings = models or MODELS, settings or {}
    fitted = Fitted(target, columns, list(keys))
    if "ridge" in chosen:
        fitted.ridge = cut_lineage(ridge(train, target, columns, keys, settings.get("ridge", {}).get("alpha", RIDGE_ALPHA)))
    named = [m for m in chosen if m != "ridge"]
    if named:
        matrix = cut_lineage(tree_matrix(fitted, train))
        fits = [lambda name=name: tree_model(name, matrix, target, store, **settings.get(name, {})) for name in named]
        fitted.trees = dict(zip(named, side_by_side(fits, matrix.sparkSession), strict=True))
    return fitted


def side_by_side(works: list[Callable[[], object]], spark: SparkSession) -> list:
    """Results of works that start Spark jobs of their own, done at the same time."""
    with ThreadPoolExecutor(max(1, len(works))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(work)) for work in works]]


def model_matrix(
    daily: DataFrame, target: str, start: str, end: str, keys: Keys = ()
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Complete training and test rows with their model inputs, written once for all fits."""
    frame = features.feature_frame(daily, target, start, keys)
    columns = features.feature_columns(frame, target)
    flags = [f.name for f in frame.schema if f.name in columns and f.dataType.simpleString() == "boolean"]
    numeric = coerce_numeric(frame, [c for c in columns if c not in flags])
    complete = cut_lineage(numeric.na.drop(subset=[target, *columns]))
    train, test = time_split(complete, start, end, target)
    return train, test, columns


def predict(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Forecast columns of every fitted model next to ``actual``."""
    out = rows
    if fitted.ridge is not None:
        out = predict_linear(out, fitted.ridge, fitted.columns, fitted.keys, "ridge_forecast")
    if fitted.trees:
        plain = [c for c in out.columns if c not in fitted.columns]
        whole = out.select(*plain, *fitted.columns).withColumn("_actual", F.col(fitted.target))
        out = assemble(scaled_inputs(whole, fitted), fitted.tree_columns).withColumn(fitted.target, F.col("_actual"))
        for name, model in fitted.trees.items():
            out = model.setPredictionCol(f"{name}_forecast").transform(out)
            if fitted.keys:
                out = out.withColumn(f"{name}_forecast", F.col(f"{name}_forecast") * F.col("_sd") + F.col("_mu"))
    made = [f"{m}_forecast" for m in MODELS if f"{m}_forecast" in out.columns]
    extra = [c for c in ("demand_regime",) if c in rows.columns]
    return out.select(*fitted.keys, "date", F.col(fitted.target).alias("actual"), *extra, *made)


def one_day_ahead(
    daily: DataFrame, target: str, start: str, end: str, keys: Keys = (),
    models: list[str] | None = None, settings: dict[str, dict] | None = None,
) -> tuple[DataFrame, Fitted]:
    """Forecast each test day from actual history through the day before."""
    train, test, columns = model_matrix(daily, target, start, end, keys)
    fitted = fit_models(train, target, columns, keys, models, settings)
    return predict(fitted, test), fitted


def importance_table(fitted: Fitted) -> DataFrame:
    """Importance of every input in each tree model."""
    rows = [
        (name, column, float(weight))
        for name, model in fitted.trees.items()
        for column, weight in zip(fitted.tree_columns, model.featureImportances.toArray())
    ]
    return SparkSession.active().createDataFrame(rows, "model string, feature string, importance double")


def mean_importance(importance: DataFrame) -> DataFrame:
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance"))


def ridge_coefficients(fitted: Fitted) -> DataFrame:
    return coefficient_table(fitted.ridge, fitted.columns, fitted.keys)


def regime_metrics(forecasts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Accuracy per regime and model of a wide forecast table."""
    long = evaluate.long_forecasts(forecasts, keys, ["demand_regime"])
    return evaluate.metrics(long, [*keys, "demand_regime", "model"])
