"""Preparation, metrics and model fits."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.__main__ import main, parse
from phasewise.models import estimators, training
from phasewise.models.estimators import CLASSIFIERS, REGRESSORS, sample_grid
from phasewise.operators import metrics, prepare
from phasewise.plans import sweeps
from phasewise.sources import sinks
from tests.frames import trial, trials


def matrix(spark, labels):
    rows = [(f"d{i}", float(label)) for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "drug string, label double")


def digest(drug):
    return hashlib.md5(f"42|{drug}".encode()).hexdigest()


@pytest.mark.parametrize("rows", [1, 2, 7, 15, 200])
def test_split_takes_exactly_the_share(spark, rows):
    data = prepare.with_split(matrix(spark, [0] * rows)).collect()
    order = sorted((r["drug"] for r in data), key=digest)
    expected = set(order[: math.ceil(0.2 * rows)])
    assert {r["drug"] for r in data if r["split"] == "test"} == expected


@pytest.mark.parametrize("stratified", [True, False])
def test_folds_are_consecutive_blocks(spark, stratified):
    # One label holds most rows, one has fewer rows than there are folds.
    labels = [0] * 100 + [1] * 13 + [2] * 4
    got = {r["drug"]: r["fold"] for r in prepare.with_folds(matrix(spark, labels), 6, stratified).collect()}
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label if stratified else 0, []).append(f"d{i}")
    for drugs in groups.values():
        order = sorted(drugs, key=digest)
        blocks = np.array_split(np.array(order, dtype=object), 6)
        for fold, block in enumerate(blocks):
            assert {got[d] for d in block} <= {fold}


def test_class_weights(spark):
    rows = prepare.with_class_weights(matrix(spark, [0, 0, 0, 1])).collect()
    assert {(r["label"], round(r["weight"], 6)) for r in rows} == {(0.0, 0.666667), (1.0, 2.0)}


def test_scaling_uses_the_population_deviation(spark):
    frame = spark.createDataFrame([("a", 1.0, 5.0, 0.0), ("b", 3.0, 5.0, 1.0)],
                                  "drug string, x double, c double, label double")
    rows = {r["drug"]: (r["x"], r["c"]) for r in prepare.scaled(frame).collect()}
    assert rows == {"a": (-1.0, 0.0), "b": (1.0, 0.0)}


def test_one_label_column_is_required(spark):
    frame = spark.createDataFrame([("a", True, True)], "drug string, `x Pass` boolean, `y Pass` boolean")
    with pytest.raises(ValueError):
        prepare.pass_matrix(frame)


PHASE = "Phase I"


def phase_rows(spark, n=120):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        subjects = rng.choice([None, 0.0, rng.uniform(1, 300)])
        length = rng.choice([0.0, 300.0, 700.0, 1500.0])
        reached = (subjects or 0) + rng.uniform(0, 100) > 90
        rows.append((f"d{i}", subjects, length, rng.uniform(0, 9), reached, rng.randint(0, 3),
                     rng.randint(0, 2), rng.randint(0, 5)))
    return spark.createDataFrame(
        rows,
        f"drug string, `{PHASE} subject mean` double, `{PHASE} trial length` double, "
        f"`{PHASE} center count` double, `{PHASE} Pass` boolean, `{PHASE} Completed` int, "
        f"`{PHASE} open` int, `Number of Organizations` int",
    )


def test_matrices(spark):
    table = phase_rows(spark)
    passes, times, lengths = map(lambda f: f(table), training.MATRICES.values())
    assert prepare.feature_names(passes) == [
        f"{PHASE} subject mean", f"{PHASE} trial length", f"{PHASE} center count",
        f"{PHASE} open", "Number of Organizations",
    ]
    assert f"{PHASE} trial length" not in times.columns
    assert {r[0] for r in times.select("label").distinct().collect()} == {0.0, 1.0, 2.0}
    assert f"{PHASE} Completed" in lengths.columns
    assert f"{PHASE} Completed" not in prepare.length_matrix(table, without_leaky=True).columns
    nulls = passes.select([F.count_if(F.col(f"`{c}`").isNull()) for c in passes.columns]).first()
    assert set(nulls) == {0}


def predictions(spark, rows, classes):
    data = [(float(y), float(p), [float(v) for v in q]) for y, p, q in rows]
    return spark.createDataFrame(data, "label double, prediction double, probability array<double>")


def test_binary_scores(spark):
    frame = predictions(spark, [(1, 1, (0.2, 0.8)), (1, 0, (0.6, 0.4)), (0, 1, (0.0, 1.0)), (0, 0, (0.9, 0.1))], 2)
    got = metrics.binary_scores(frame).first().asDict()
    expected = math.exp(np.mean(np.log([0.8, 0.4, 1e-15, 0.9])))
    assert got["confidence"] == pytest.approx(expected)
    assert [got[k] for k in ("accuracy", "precision", "recall", "f1")] == [0.5] * 4
    none = metrics.binary_scores(frame.filter("label = 0 and prediction = 0")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_weighted_scores(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2), (2, 2)]
    frame = predictions(spark, [(y, p, (1, 0, 0)) for y, p in pairs], 3)
    got = metrics.weighted_precision_recall_f1(frame).first()
    weight = {0: 2, 1: 1, 2: 3}
    precision = {0: 1 / 2, 1: 1 / 2, 2: 1.0}
    recall = {0: 1 / 2, 1: 1.0, 2: 2 / 3}
    f1 = {k: 2 * precision[k] * recall[k] / (precision[k] + recall[k]) for k in weight}
    for name, score in (("precision", precision), ("recall", recall), ("f1", f1)):
        expected = sum(weight[k] * score[k] for k in weight) / 6
        assert got[f"weighted_{name}"] == pytest.approx(expected)


def test_naive_baselines(spark):
    train, test = matrix(spark, [0, 1]), matrix(spark, [0, 0, 1])
    # A mean of one half rounds to the even number.
    assert metrics.naive_accuracy(train, test).first()[0] == pytest.approx(2 / 3)
    assert metrics.naive_confidence(train, test).first()[0] == pytest.approx(0.5)
    shares = {r["label"]: r["share"] for r in metrics.class_shares(train).collect()}
    assert shares == {0: 0.5, 1: 0.5, 2: 0.0}


def test_rmse(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "label double, prediction double")
    assert frame.agg(metrics.rmse()).first()[0] == pytest.approx(math.sqrt(5))


def test_grid_samples_are_seeded_and_distinct():
    choices = {"a": list(range(10)), "b": list(range(7)), "c": [1]}
    assert len(sample_grid(choices, None)) == 70
    points = sample_grid(choices, 12)
    assert points == sample_grid(choices, 12) and len({tuple(p.values()) for p in points}) == 12
    assert all(p["a"] in choices["a"] and p["b"] in choices["b"] for p in points)


# Small models of each kind; a model without a grid has nothing to set.
SMALL = {
    "logistic_regression": {"regParam": 0.1}, "lasso": {"regParam": 0.1}, "ridge": {"regParam": 0.1},
    "random_forest": {"numTrees": 3, "maxDepth": 3}, "rfregression": {"numTrees": 3, "maxDepth": 3},
    "xgboost": {"maxIter": 2, "maxDepth": 3}, "xgbreg": {"maxIter": 2, "maxDepth": 3},
    "gbreg": {"maxIter": 2},
}


@pytest.fixture(scope="module")
def inputs(spark):
    table = phase_rows(spark)
    return {
        task: training.model_input(training.MATRICES[task](table), 2, stratified=task != "length")
        for task in training.TASKS
    }


@pytest.mark.parametrize(
    "task, model_type",
    [(t, m) for t in ("pass", "time") for m in CLASSIFIERS] + [("length", m) for m in REGRESSORS],
)
def test_models(inputs, task, model_type):
    fitted = training.fit(inputs[task], task, model_type, point=SMALL.get(model_type, {}))
    assert fitted.cv_score is None and fitted.best == SMALL.get(model_type, {})
    rows = training.predict(fitted).collect()
    assert len(rows) == 24
    classes = training.TASKS[task]
    for row in rows:
        if classes:
            assert len(row["probability"]) == classes
            assert sum(row["probability"]) == pytest.approx(1.0)
            assert all(0 <= p <= 1 for p in row["probability"])
            assert row["prediction"] in range(classes)
        else:
            assert math.isfinite(row["prediction"])


def test_unknown_model_is_refused():
    with pytest.raises(ValueError):
        training.model_builder("pass", "ols")


def test_odds_and_scores(inputs):
    fitted = training.fit(inputs["pass"], "pass", "logistic_regression", 2, 2)
    odds = {r["feature"]: r["odds"] for r in training.odds_coefficients(fitted).collect()}
    assert set(odds) == set(fitted.features) and all(v > 0 for v in odds.values())
    scores = {r["metric"]: r["value"] for r in training.score(fitted).collect()}
    assert set(scores) == {"accuracy", "precision", "recall", "f1", "confidence", "naive_accuracy",
                           "naive_confidence", "cv_score"}
    assert scores["cv_score"] == pytest.approx(fitted.cv_score)


def test_sweep_logs_every_model(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    sinks.write_phase_tables(phase_rows(spark), store, [PHASE])
    scores = sweeps.time_sweep(spark, store, ("gaussian_naive_bayes", "multinomial_naive_bayes"),
                               phases=[PHASE], folds=2, score_path=log)
    logged = spark.read.parquet(log)
    assert logged.count() == scores.count() == 14
    assert {r[0] for r in logged.select("model").distinct().collect()} == {
        "gaussian_naive_bayes", "multinomial_naive_bayes"}
    with pytest.raises(ValueError):
        sweeps.pass_sweep(spark, store, ("ols",))


def test_stopped_sweep_resumes_without_double_rows(spark, tmp_path, monkeypatch):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    sinks.write_phase_tables(phase_rows(spark), store, [PHASE])
    real, calls = sweeps.fit, []

    def stopping(data, task, model_type, *args):
        calls.append(model_type)
        if model_type == "multinomial_naive_bayes" and calls.count(model_type) == 1:
            raise RuntimeError("executor lost")
        return real(data, task, model_type, *args)

    monkeypatch.setattr(sweeps, "fit", stopping)
    models = ("gaussian_naive_bayes", "multinomial_naive_bayes")
    with pytest.raises(RuntimeError):
        sweeps.time_sweep(spark, store, models, phases=[PHASE], folds=2, score_path=log)
    assert spark.read.parquet(log).count() == 7
    scores = sweeps.time_sweep(spark, store, models, phases=[PHASE], folds=2, score_path=log)
    assert calls == ["gaussian_naive_bayes", "multinomial_naive_bayes", "multinomial_naive_bayes"]
    logged = spark.read.parquet(log)
    assert logged.count() == scores.count() == 14
    again = sweeps.time_sweep(spark, store, models, phases=[PHASE], folds=2, score_path=log)
    assert len(calls) == 3 and again.count() == 14 and spark.read.parquet(log).count() == 14


def test_command_line_extracts_and_fits(spark, tmp_path):
    rows = [
        trial(f"drug {i % 40}", phase, start=str(2001 + i % 7), end="01 Jan 2012",
              planned_subject_number=float(i % 5), trial_status="Completed", trial_design="open")
        for i in range(120)
        for phase in ("Phase I", "Phase II", "Phase III")
        if (i + len(phase)) % 3
    ]
    source, wide, phases, scores = (str(tmp_path / n) for n in ("trials", "wide", "phases", "scores"))
    trials(spark, rows).write.parquet(source)
    main(["extract", source, wide, phases])
    main(["fit", phases, scores, "--models", "gaussian_naive_bayes", "--folds", "2", "--task", "time"])
    logged = spark.read.parquet(scores)
    assert {r[0] for r in logged.select("phase").distinct().collect()} == {
        "Phase I", "Phase II", "Phase III"}


def test_whole_grid_unless_a_sample_is_asked_for():
    whole = estimators.logistic_regression(["a"], 10, 2)
    some = estimators.logistic_regression(["a"], 10, 2, max_points=4)
    assert len(whole.grid) == 30 and whole.left_out == 0
    assert len(some.grid) == 4 and some.left_out == 26
    assert parse(["fit", "p", "s"]).sample_points is None


def test_odds_are_logged(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    sinks.write_phase_tables(phase_rows(spark), store, [PHASE])
    sweeps.pass_sweep(spark, store, ("logistic_regression",), phases=[PHASE], folds=2,
                      max_points=2, score_path=log)
    rows = spark.read.parquet(log).collect()
    odds = [r for r in rows if r["metric"].startswith("odds ")]
    assert odds and all(r["value"] > 0 for r in odds)
    assert {r["points_left_out"] for r in rows} == {28}
