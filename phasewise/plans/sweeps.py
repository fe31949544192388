"""Sweeps of several models over the stored phase tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.constants import FOLDS, MODEL_PHASES
from phasewise.models.training import MATRICES, fit, log_rows, model_builder, model_input
from phasewise.sources.readers import read_phase_table
from phasewise.sources.sinks import logged_unit, union_all, write_unit


def sweep(spark: SparkSession, phase_path: str, task: str, models: list[str],
          phases: list[str] = MODEL_PHASES, score_path: str | None = None,
          folds: int = FOLDS, max_points: int | None = None, parallelism: int = 4) -> DataFrame:
    """Fit every model on every phase; one row per phase, model and metric.

    The whole grid is searched unless ``max_points`` asks for a sample; the number of points
    a sample leaves out stands next to the scores. Odds of logistic models are metrics, too.

    The model input of a phase is prepared once for all models, and up to ``parallelism`` phases
    are worked on at once: most of their jobs are too short to fill a cluster. With a score
    path, each unit of work (task, phase, model, folds and sample) is written to the log as its
    own folder as soon as it is known, and a unit that the log already holds is read instead of
    fitted again: a sweep that was stopped resumes where it stood, and a unit that was tried
    twice is in the log once.
    """
    for model_type in models:
        model_builder(task, model_type)

    def of_phase(phase: str) -> list[DataFrame]:
        data, results = None, []
        for model_type in models:
            unit = f"{task}|{phase}|{model_type}|folds={folds}|points={max_points}"
            done = logged_unit(spark, score_path, unit) if score_path else None
            if done is not None:
                results.append(done.drop("scored_at"))
                continue
            if data is None:
                matrix = MATRICES[task](read_phase_table(spark, phase_path, phase))
                data = model_input(matrix, folds, stratified=task != "length", stored=True)
            fitted = fit(data, task, model_type, folds, max_points, parallelism)
            scores = log_rows(fitted).withColumns({
                "phase": F.lit(phase),
                "parameters": F.lit(str(fitted.best)),
                "points_left_out": F.lit(fitted.left_out),
            })
            if score_path is not None:
                write_unit(scores.withColumn("scored_at", F.current_timestamp()), score_path, unit)
            results.append(scores)
        return results

    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(of_phase, phases))
    return union_all([scores for results in found for scores in results])


def pass_sweep(spark: SparkSession, phase_path: str,
               models: tuple[str, ...] = ("logistic_regression", "random_forest"),
               **options) -> DataFrame:
    return sweep(spark, phase_path, "pass", list(models), **options)


def time_sweep(spark: SparkSession, phase_path: str,
               models: tuple[str, ...] = ("logistic_regression", "random_forest"),
               **options) -> DataFrame:
    return sweep(spark, phase_path, "time", list(models), **options)


def length_sweep(spark: SparkSession, phase_path: str,
                 models: tuple[str, ...] = ("ols", "lasso", "ridge", "rfregression", "xgbreg"),
                 **options) -> DataFrame:
    return sweep(spark, phase_path, "length", list(models), **options)
