"""Grid search, prediction and scoring of one model on one phase table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.constants import FOLDS
from phasewise.models import bayes_search, logistic_search
from phasewise.models.estimators import CLASSIFIERS, REGRESSORS
from phasewise.operators import metrics, prepare
from phasewise.session import materialise

# Task -> number of classes; a regression has none.
TASKS = {"pass": 2, "time": 3, "length": 0}
MATRICES = {
    "pass": prepare.pass_matrix,
    "time": prepare.time_matrix,
    "length": prepare.length_matrix,
}


@dataclass
class Fitted:
    """The refitted winner of a grid search, with the rows it was fitted on and kept from."""

    task: str
    model_type: str
    model: PipelineModel
    cv_score: float | None
    best: dict
    features: list[str]
    train: DataFrame
    test: DataFrame
    left_out: int = 0


def model_builder(task: str, model_type: str):
    known = CLASSIFIERS if TASKS[task] else REGRESSORS
    if model_type not in known:
        raise ValueError(f"unknown model {model_type!r}, choose from {sorted(known)}")
    return known[model_type]


def model_input(matrix: DataFrame, folds: int = FOLDS, stratified: bool = True,
                stored: bool = False) -> DataFrame:
    """The matrix with split, fold and class weight, written for all later passes.

    Folds and weights are those of the training rows; test rows carry neutral values. The
    matrix itself is read several times and written first, unless it only picks columns of a
    stored table.
    """
    split = prepare.with_split(matrix if stored else materialise(matrix, "matrix"))
    train = split.filter("split = 'train'")
    train = prepare.with_folds(train, folds, stratified)
    if stratified:
        train = prepare.with_class_weights(train)
    else:
        train = train.withColumn("weight", F.lit(1.0))
    test = split.filter("split = 'test'").withColumns({"fold": F.lit(0), "weight": F.lit(1.0)})
    return materialise(train.unionByName(test), "model-input")


def fit(data: DataFrame, task: str, model_type: str, folds: int = FOLDS,
        max_points: int | None = None, parallelism: int = 4,
        point: dict | None = None) -> Fitted:
    """Search the whole grid by cross-validation and refit the best point on all training rows.

    ``max_points`` searches a seeded sample of the grid instead. ``point`` names parameters
    and their values and skips the search; then there is no ``cv_score``.
    """
    known = model_builder(task, model_type)
    train = data.filter("split = 'train'")
    test = data.filter("split = 'test'")
    features = prepare.feature_names(data)
    arguments = {"classes": TASKS[task]} if TASKS[task] else {}

    def build(rows: int):
        return known(features, rows, max_points=max_points, **arguments)

    # Penalties follow the number of rows fitted on, that of the fold in the search.
    candidate = build(train.count())
    if point is None:
        means = _search(train, build, TASKS[task], folds, parallelism)
        best = max(range(len(means)), key=means.__getitem__)
        chosen, cv_score = candidate.grid[best], means[best]
    else:
        chosen, cv_score = candidate.point(point), None
    preparation = candidate.preparation.fit(train)
    model = candidate.estimator.fit(preparation.transform(train), chosen)
    return Fitted(
        task, model_type, PipelineModel([*preparation.stages, model]), cv_score,
        {param.name: value for param, value in chosen.items()}, features, train, test,
        candidate.left_out,
    )


def _search(train: DataFrame, build, classes: int, folds: int, parallelism: int) -> list[float]:
    """Mean score of each grid point over the folds; features are prepared once per fold.

    Logistic regressions are searched all at once, see ``logistic_search``, and so are the folds
    of naive Bayes, see ``bayes_search``. A grid of one point reads a fold's rows too seldom to
    store them.
    """
    candidate = build(1)
    if isinstance(candidate.searched, LogisticRegression):
        return logistic_search.search(train, build, folds, classes)
    if bayes_search.applies(candidate):
        return bayes_search.search(train, candidate, folds)
    single = len(candidate.grid) == 1
    sizes = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
             .collect()}

    def of_fold(fold: int) -> list[float]:
        rest = train.filter(F.col("fold") != fold)
        candidate = build(sum(sizes.values()) - sizes.get(fold, 0))
        preparation = candidate.preparation.fit(rest)
        kept = ["features", "label", "weight"]
        fitted_on = preparation.transform(rest).select(*kept)
        held = preparation.transform(train.filter(F.col("fold") == fold)).select(*kept)
        if single:
            return [_held_score(candidate.estimator.fit(fitted_on, candidate.grid[0]), held, classes)]
        fitted_on, held = fitted_on.persist(), held.persist()

        def one(chosen: dict) -> float:
            return _held_score(candidate.estimator.fit(fitted_on, chosen), held, classes)

        with ThreadPoolExecutor(parallelism) as pool:
            found = list(pool.map(one, candidate.grid))
        fitted_on.unpersist()
        held.unpersist()
        return found

    with ThreadPoolExecutor(parallelism if single else 1) as pool:
        scores = list(pool.map(of_fold, range(folds)))
    return [sum(column) / folds for column in zip(*scores)]


def _held_score(model, held: DataFrame, classes: int) -> float:
    """Accuracy of a classifier, R2 of a regression, on rows it was not fitted on."""
    predicted = model.transform(held)
    if classes:
        # No rows have no accuracy.
        return predicted.agg(
            F.coalesce(F.try_divide(F.count_if(F.col("label") == F.col("prediction")),
                                    F.count(F.lit(1))), F.lit(float("nan")))).first()[0]
    return RegressionEvaluator(metricName="r2").evaluate(predicted)


def predict(fitted: Fitted, rows: DataFrame | None = None) -> DataFrame:
    """Predictions with one probability per class; regressions have none.

    A one-against-rest model only has margins: each becomes a probability on its own, and
    the row is scaled to sum to one.
    """
    scored = fitted.model.transform(fitted.test if rows is None else rows)
    kept = ["drug", "label", "prediction"]
    if not TASKS[fitted.task]:
        return scored.select(*kept)
    if "probability" in scored.columns:
        probability = vector_to_array("probability")
    else:
        steep = 2.0 if fitted.model_type == "xgboost" else 1.0
        single = F.transform(
            vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-steep * m))
        )
        total = F.aggregate(single, F.lit(0.0), lambda a, b: a + b)
        probability = F.transform(single, lambda p: p / total)
    return scored.select(*kept, probability.alias("probability"))


def score(fitted: Fitted) -> DataFrame:
    """All scores of a model as rows of metric and value, naive baselines included."""
    predictions = predict(fitted)
    if fitted.task == "pass":
        table = metrics.binary_scores(predictions)
        naive = [
            metrics.naive_accuracy(fitted.train, fitted.test),
            metrics.naive_confidence(fitted.train, fitted.test),
        ]
    elif fitted.task == "time":
        table = metrics.multiclass_scores(predictions)
        naive = [metrics.naive_class_confidence(fitted.train, fitted.test)]
    else:
        table = predictions.agg(metrics.rmse().alias("rmse"))
        naive = []
    for extra in naive:
        table = table.withColumn(extra.columns[0], extra.scalar())
    if fitted.cv_score is not None:
        table = table.withColumn("cv_score", F.lit(fitted.cv_score))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
            for name in table.columns
        ]
    )
    return table.select(
        F.lit(fitted.task).alias("task"),
        F.lit(fitted.model_type).alias("model"),
        F.inline(rows),
    )


def odds_coefficients(fitted: Fitted) -> DataFrame:
    """exp(coefficient) per feature of a logistic model; of the first class if several."""
    last = fitted.model.stages[-1]
    model = last.models[0] if hasattr(last, "models") else last
    # One row per feature column.
    odds = list(zip(fitted.features, [float(c) for c in model.coefficients]))
    spark = fitted.train.sparkSession
    return spark.createDataFrame(odds, "feature string, coefficient double").select(
        "feature", F.exp("coefficient").alias("odds")
    )


def log_rows(fitted: Fitted) -> DataFrame:
    """The scores of a model, and for a logistic one the odds of each feature."""
    rows = score(fitted)
    if fitted.model_type != "logistic_regression":
        return rows
    odds = odds_coefficients(fitted).select(
        F.lit(fitted.task).alias("task"), F.lit(fitted.model_type).alias("model"),
        F.concat(F.lit("odds "), "feature").alias("metric"), F.col("odds").alias("value"))
    return rows.unionByName(odds)
