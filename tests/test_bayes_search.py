"""The joint search of naive Bayes over the folds against one MLlib fit per fold."""

import math
import threading

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from phasewise.models import training
from phasewise.models.estimators import gaussian_naive_bayes, multinomial_naive_bayes
from phasewise.plans import sweeps

FOLDS = 3
# A name with a blank, as columns of wide tables have.
NAMES = ["a", "b 1", "c", "d"]
MODELS = {"gaussian_naive_bayes": gaussian_naive_bayes,
          "multinomial_naive_bayes": multinomial_naive_bayes}


def rows_of(spark, label, skip=()):
    rows = []
    for i in range(300):
        a, b = math.sin(i * 1.7) * 5 + 6, math.cos(i * 2.3) * 100 + 140
        # c is constant, d differs from zero in fold 0 only.
        rows.append((f"d{i}", a, b, 0.1, float(i % FOLDS == 0), float(label(i, a, b)), i % FOLDS,
                     1.0, "train" if i % 5 else "test"))
    return spark.createDataFrame(
        [r for r in rows if r[6] not in skip],
        "drug string, a double, `b 1` double, c double, d double, label double, fold int, "
        "weight double, split string").repartition(3)


def binary(i, a, b):
    return a + b / 30 + 3 * math.sin(i * i) > 10


def ternary(i, a, b):
    return (a + 3 * math.sin(i * i) > 6) + (b + 90 * math.cos(i * i) > 150)


def lacking(i, a, b):
    # The rows outside fold 0 all have label 1.
    return i % FOLDS != 0 or a > 6


def single_fits(train, build):
    evaluator, scores = MulticlassClassificationEvaluator(metricName="accuracy"), []
    for fold in range(FOLDS):
        rest, held = train.filter(F.col("fold") != fold), train.filter(F.col("fold") == fold)
        candidate = build(rest.count())
        preparation = candidate.preparation.fit(rest)
        model = candidate.estimator.fit(preparation.transform(rest))
        scores.append(evaluator.evaluate(model.transform(preparation.transform(held))))
    return [sum(scores) / FOLDS]


@pytest.mark.parametrize("model_type", MODELS)
@pytest.mark.parametrize("label, classes", [(binary, 2), (ternary, 3), (lacking, 2)])
def test_scores_equal_those_of_single_fits(spark, label, classes, model_type):
    train = rows_of(spark, label).filter("split = 'train'").localCheckpoint()

    def build(rows):
        return MODELS[model_type](NAMES, rows, classes)

    got = training._search(train, build, classes, FOLDS, 4)
    assert got == pytest.approx(single_fits(train, build), abs=1e-12)


def test_a_fold_without_rows_has_no_score(spark):
    train = rows_of(spark, binary, skip=(1,)).filter("split = 'train'")
    got = training._search(train, lambda n: gaussian_naive_bayes(NAMES, n, 2), 2, FOLDS, 4)
    assert len(got) == 1 and math.isnan(got[0])


@pytest.mark.parametrize("model_type", MODELS)
def test_folds_are_fitted_together(spark, model_type, monkeypatch):
    """Only the refit is a fit of its own."""
    real, calls = NaiveBayes._fit, []

    def counting(self, data):
        calls.append(1)
        return real(self, data)

    monkeypatch.setattr(NaiveBayes, "_fit", counting)
    fitted = training.fit(rows_of(spark, binary), "pass", model_type, FOLDS)
    assert len(calls) == 1 and 0.5 < fitted.cv_score <= 1


def test_a_stored_matrix_is_not_written_again(spark, monkeypatch):
    matrix = rows_of(spark, binary).drop("split", "fold", "weight").localCheckpoint()
    real, written = training.materialise, []

    def counting(df, name="table"):
        written.append(name)
        return real(df, name)

    monkeypatch.setattr(training, "materialise", counting)
    stored = training.model_input(matrix, FOLDS, stored=True)
    assert written == ["model-input"]
    assert sorted(stored.collect()) == sorted(training.model_input(matrix, FOLDS).collect())


def test_phases_are_swept_side_by_side(spark, monkeypatch):
    # Each phase waits for the other one; one after the other would break the barrier.
    both = threading.Barrier(2)

    def waiting(data, task, model_type, *args):
        both.wait(timeout=60)
        return data

    monkeypatch.setattr(sweeps, "read_phase_table", lambda spark, path, phase: phase)
    monkeypatch.setitem(sweeps.MATRICES, "pass", lambda phase: phase)
    monkeypatch.setattr(sweeps, "model_input", lambda matrix, *args, **options: Named(matrix))
    monkeypatch.setattr(sweeps, "fit", waiting)
    monkeypatch.setattr(sweeps, "log_rows", lambda fitted: spark.range(1))
    found = sweeps.pass_sweep(spark, "", ("gaussian_naive_bayes",), phases=["Phase II", "Phase I"])
    assert [r["phase"] for r in found.collect()] == ["Phase II", "Phase I"]


class Named:
    best, left_out = {}, 0

    def __init__(self, phase):
        self.phase = phase
