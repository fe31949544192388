"""Model pipelines and their search grids, one per model name and task."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

SEED = 42
# Fixed value: the deepest tree MLlib grows.
MAX_DEPTH = 30


@dataclass(frozen=True)
class Candidate:
    """How to prepare features, what to fit on them, and the parameter maps to try.

    ``left_out`` counts points of the whole grid that a sample asked for does not try.
    """

    preparation: Pipeline
    estimator: Estimator
    searched: Estimator
    grid: list[dict]
    left_out: int = 0

    def point(self, values: dict) -> dict:
        """A parameter map from names and values."""
        return {self.searched.getParam(name): value for name, value in values.items()}


def log_steps(low: float, high: float, count: int) -> list[float]:
    """Powers of ten with exponents in equal steps, ends included."""
    step = (high - low) / (count - 1)
    return [10 ** (low + i * step) for i in range(count)]


def sample_grid(choices: dict, max_points: int | None, seed: int = SEED) -> list[dict]:
    """All combinations; with a limit, a seeded sample of them if there are more."""
    names = list(choices)
    sizes = [len(choices[name]) for name in names]
    total = math.prod(sizes)
    if max_points is None or total <= max_points:
        points = itertools.product(*choices.values())
    else:
        points = []
        for number in sorted(random.Random(seed).sample(range(total), max_points)):
            point = []
            for name, size in zip(reversed(names), reversed(sizes)):
                number, index = divmod(number, size)
                point.append(choices[name][index])
            points.append(tuple(reversed(point)))
    return [dict(zip(names, point)) for point in points]


def _assemble(features: list[str], rows: int, scale: bool) -> list:
    """Feature vector, and if asked for scaled by the population standard deviation."""
    stages = [VectorAssembler(inputCols=features, outputCol="features" if not scale else "raw")]
    if scale:
        # The scaler divides by the sample deviation; the factor turns it into the other.
        factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
        stages += [
            StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=True),
            ElementwiseProduct(
                inputCol="centred",
                outputCol="features",
                scalingVec=Vectors.dense([factor] * len(features)),
            ),
        ]
    return stages


def _candidate(features, rows, scale, estimator: Estimator, choices: dict, max_points,
               classes: int = 2, weighted: bool = False) -> Candidate:
    last = estimator
    if classes > 2:
        # One model's passes are many and short; the classes' fits fill each other's gaps.
        last = OneVsRest(classifier=estimator, labelCol="label", featuresCol="features",
                         parallelism=classes)
        if weighted:
            last = last.setWeightCol("weight")
    grid = sample_grid(choices, max_points)
    left_out = math.prod(len(c) for c in choices.values()) - len(grid)
    preparation = Pipeline(stages=_assemble(features, rows, scale))
    return Candidate(preparation, last, estimator, grid, left_out)


# The ranges searched, in the functions below.


def logistic_regression(features, rows, classes, max_points=None) -> Candidate:
    model = LogisticRegression(
        elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=100
    )
    inverse = log_steps(-4, 2, 30) if classes == 2 else log_steps(-4, 1, 10)
    choices = {model.regParam: [1.0 / (c * rows) for c in inverse]}
    return _candidate(features, rows, True, model, choices, max_points, classes, weighted=True)


def gaussian_naive_bayes(features, rows, classes, max_points=None) -> Candidate:
    model = NaiveBayes(modelType="gaussian")
    return _candidate(features, rows, True, model, {}, max_points)


def multinomial_naive_bayes(features, rows, classes, max_points=None) -> Candidate:
    model = NaiveBayes(modelType="multinomial", smoothing=1.0)
    return _candidate(features, rows, False, model, {}, max_points)


def random_forest(features, rows, classes, max_points=None) -> Candidate:
    model = RandomForestClassifier(featureSubsetStrategy="auto", weightCol="weight", seed=SEED)
    choices = {
        model.numTrees: [20, 40, 60, 80, 100, 500],
        model.maxDepth: list(range(10, 21)),
        model.minInstancesPerNode: [2, 4, 6, 8, 10],
    }
    return _candidate(features, rows, False, model, choices, max_points)


def boosted_trees(features, rows, classes, max_points=None) -> Candidate:
    model = GBTClassifier(seed=SEED)
    rounds = [40, 50, 70, 80, 90, 100] + ([200, 500] if classes > 2 else [])
    choices = {
        model.stepSize: log_steps(-3, -1, 10),
        model.maxDepth: [3, 4, 5, 6],
        model.maxIter: rounds,
        model.subsamplingRate: [0.6, 0.7],
    }
    return _candidate(features, rows, False, model, choices, max_points, classes)


def ols(features, rows, max_points=None) -> Candidate:
    model = LinearRegression(regParam=0.0, standardization=False)
    choices = {model.fitIntercept: [True, False]}
    return _candidate(features, rows, True, model, choices, max_points)


def lasso(features, rows, max_points=None) -> Candidate:
    model = LinearRegression(elasticNetParam=1.0, standardization=False)
    choices = {model.regParam: log_steps(-4, 4, 20), model.fitIntercept: [True, False]}
    return _candidate(features, rows, True, model, choices, max_points)


def ridge(features, rows, max_points=None) -> Candidate:
    model = LinearRegression(elasticNetParam=0.0, standardization=False)
    choices = {
        model.regParam: [alpha / rows for alpha in log_steps(-4, 4, 20)],
        model.fitIntercept: [True, False],
    }
    return _candidate(features, rows, True, model, choices, max_points)


def forest_regression(features, rows, max_points=None) -> Candidate:
    model = RandomForestRegressor(featureSubsetStrategy="all", seed=SEED)
    # The searched range goes on to 40, which MLlib refuses; its deepest trees stand for that.
    choices = {
        model.maxDepth: [2, 4, 6, 8, 10, 20, MAX_DEPTH],
        model.numTrees: [20, 40, 50, 60, 70, 80, 100, 300],
    }
    return _candidate(features, rows, True, model, choices, max_points)


def gradient_boosting(features, rows, max_points=None) -> Candidate:
    model = GBTRegressor(lossType="absolute", seed=SEED)
    choices = {model.stepSize: [0.1], model.maxIter: [100]}
    return _candidate(features, rows, True, model, choices, max_points)


def boosted_regression(features, rows, max_points=None) -> Candidate:
    model = GBTRegressor(seed=SEED)
    choices = {
        model.stepSize: [0.01, 0.03, 0.05, 0.07],
        model.maxDepth: [2, 3, 4],
        model.maxIter: [40, 50, 70, 80, 90, 100, 200],
        model.subsamplingRate: [0.6, 0.7],
    }
    return _candidate(features, rows, False, model, choices, max_points)


# Model names users pick from.
CLASSIFIERS = {
    "logistic_regression": logistic_regression,
    "gaussian_naive_bayes": gaussian_naive_bayes,
    "multinomial_naive_bayes": multinomial_naive_bayes,
    "random_forest": random_forest,
    "xgboost": boosted_trees,
}
REGRESSORS = {
    "ols": ols,
    "lasso": lasso,
    "ridge": ridge,
    "rfregression": forest_regression,
    "gbreg": gradient_boosting,
    "xgbreg": boosted_regression,
}
