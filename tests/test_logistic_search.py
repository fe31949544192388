"""The joint search of logistic regressions against one MLlib fit per fold, point and class."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from phasewise.models import logistic_search, training
from phasewise.models.estimators import (
    boosted_trees,
    gaussian_naive_bayes,
    logistic_regression,
)

FOLDS = 3
NAMES = ["a", "b", "c", "d"]


def rows_of(spark, label, folds=FOLDS):
    rows = []
    for i in range(240):
        a, b = math.sin(i * 1.7) * 5, math.cos(i * 2.3) * 100 + 40
        # d differs from zero in fold 0 only, so it is constant for the models held against it.
        rows.append((f"d{i}", a, b, 3.0, float(i % folds == 0), float(label(i, a, b)), i % folds,
                     1.0 + i % 4, "train" if i % 5 else "test"))
    return spark.createDataFrame(
        rows, "drug string, a double, b double, c double, d double, label double, fold int, "
              "weight double, split string").coalesce(1)


def binary(i, a, b):
    return a + b / 30 + 3 * math.sin(i * i) > 1


def ternary(i, a, b):
    return (a + 3 * math.sin(i * i) > 1) + (b + 90 * math.cos(i * i) > 60)


def exact(estimator):
    return {estimator.tol: 1e-10} if estimator.hasParam("tol") else {}


def single_fits(train, build):
    evaluator, scores = MulticlassClassificationEvaluator(metricName="accuracy"), []
    for fold in range(FOLDS):
        rest, held = train.filter(F.col("fold") != fold), train.filter(F.col("fold") == fold)
        candidate = build(rest.count())
        preparation = candidate.preparation.fit(rest)
        scores.append([evaluator.evaluate(
            candidate.estimator.fit(preparation.transform(rest), {**exact(candidate.searched), **p})
            .transform(preparation.transform(held))) for p in candidate.grid])
    return [sum(column) / FOLDS for column in zip(*scores)]


@pytest.mark.parametrize("label, classes", [(binary, 2), (ternary, 3)])
def test_scores_equal_those_of_single_fits(spark, label, classes):
    train = rows_of(spark, label).filter("split = 'train'").localCheckpoint()

    def build(rows):
        return logistic_regression(NAMES, rows, classes, max_points=2)

    got = logistic_search.search(train, build, FOLDS, classes)
    assert got == pytest.approx(single_fits(train, build), abs=1e-9)


def test_a_label_that_a_fold_lacks(spark):
    # All rows outside fold 0 have label 0; those of fold 0 have label 1.
    train = rows_of(spark, lambda i, a, b: i % FOLDS == 0).filter("split = 'train'")
    got = logistic_search.search(train, lambda n: logistic_regression(NAMES, n, 2, max_points=1),
                                 FOLDS, 2)
    # Held against fold 0 everything is predicted 0; d tells the labels apart for the others.
    assert got == pytest.approx([2 / 3])


def test_separable_labels_end(spark):
    train = rows_of(spark, lambda i, a, b: a > 0).filter("split = 'train'")
    got = logistic_search.search(train, lambda n: logistic_regression(NAMES, n, 2), FOLDS, 2)
    assert len(got) == 30 and all(0 <= v <= 1 for v in got) and got[-1] > 0.95


def test_a_search_fits_mllib_models_once(spark, monkeypatch):
    """The points and folds go through the rows together; only the best one is fitted alone."""
    real, calls = LogisticRegression._fit, []

    def counting(self, data):
        calls.append(1)
        return real(self, data)

    monkeypatch.setattr(LogisticRegression, "_fit", counting)
    fitted = training.fit(rows_of(spark, binary), "pass", "logistic_regression", FOLDS, 4)
    assert len(calls) == 1 and 0.5 < fitted.cv_score <= 1


def test_classes_are_fitted_side_by_side():
    for build in (logistic_regression, boosted_trees):
        assert build(NAMES, 10, 3).estimator.getParallelism() == 3


def test_a_grid_of_one_point_stores_no_fold(spark, monkeypatch):
    train = rows_of(spark, binary).filter("split = 'train'").localCheckpoint()

    def build(rows):
        return gaussian_naive_bayes(NAMES, rows, 2)

    expected = single_fits(train, build)
    stored = []
    monkeypatch.setattr(type(train), "persist", lambda self, *a: stored.append(1) or self)
    assert training._search(train, build, 2, FOLDS, 4) == pytest.approx(expected, abs=1e-12)
    assert not stored
