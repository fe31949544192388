"""Cross-validation of a naive Bayes classifier, all folds side by side.

A naive Bayes model is a function of its classes' sizes, means and variances, and those of the
rows outside a fold add up from those of the other folds. One pass over the training rows takes
the moments of each fold and label, a second one scores each row with the model of its own
fold; a fit per fold would take three passes each. What reaches the driver is bounded by
folds x labels x features.

The models are those of MLlib's ``NaiveBayes`` without weights, on features centred and divided
by the population deviation of the fold's training rows if the preparation does that; a feature
that is constant there counts for nothing. As in MLlib, the n-th label of those rows is
predicted as n, counted from zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.operators.features import quoted

# Fixed value: MLlib's share of the largest variance that is added to all variances.
SMALLEST_SHARE = 1e-9


def _scaled(candidate) -> bool:
    return any(isinstance(s, StandardScaler) for s in candidate.preparation.getStages())


def applies(candidate) -> bool:
    """Whether the candidate is one naive Bayes model that its classes' moments determine."""
    model = candidate.searched
    if not isinstance(model, NaiveBayes) or candidate.grid != [{}] or model.isSet("weightCol"):
        return False
    kind = model.getModelType()
    return kind == "gaussian" or kind == "multinomial" and not _scaled(candidate)


def _merged(cells: list) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and squared deviations of cells taken together; equal means stay as they are."""
    n, mean, away = cells[0]
    for more, other, spread in cells[1:]:
        delta = other - mean
        away = away + spread + delta**2 * (n * more / (n + more))
        mean = mean + delta * (more / (n + more))
        n += more
    return n, mean, away


def _gaussian(by_label: list, scaled: bool):
    """Per label a constant, and per feature the centre and the factor of its distance."""
    n, _, away = _merged(by_label)
    variance = away / n
    unit = np.where(variance > 0, variance, np.inf) if scaled else np.ones(len(variance))
    least = SMALLEST_SHARE * (variance / unit).max()
    found = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for rows, mean, spread in by_label:
            own = spread / rows / unit + least
            factor = np.where(np.isfinite(unit), np.sqrt(1 / (own * unit)), 0.0)
            found.append((np.log(rows / n) - np.log(own).sum() / 2, mean, factor))
    return found


def _multinomial(by_label: list, smoothing: float):
    """Per label a constant, and per feature zero and the logarithm of its share."""
    found = []
    for rows, mean, _ in by_label:
        total = mean * rows + smoothing
        found.append((np.log(rows + smoothing), np.zeros(len(total)), np.log(total / total.sum())))
    return found


def search(train: DataFrame, candidate, folds: int) -> list[float]:
    """Mean accuracy over the folds of the candidate's only point."""
    names = candidate.preparation.getStages()[0].getInputCols()
    gaussian = candidate.searched.getModelType() == "gaussian"
    assembled = VectorAssembler(inputCols=names, outputCol="x").transform(train)
    cells = assembled.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.metrics("mean", "variance").summary(F.col("x")).alias("of"),
    ).select("fold", "label", "n", "of.mean", "of.variance").orderBy("fold", "label").collect()

    models = []
    for fold in range(folds):
        # A label's cells outside the fold, labels in ascending order.
        rest: dict[float, list] = {}
        for r in sorted(cells, key=lambda r: r["label"]):
            if r["fold"] is not None and r["fold"] != fold:
                rest.setdefault(r["label"], []).append(
                    (r["n"], r["mean"].toArray(), r["variance"].toArray() * (r["n"] - 1)))
        if not rest:
            raise ValueError(f"no training rows outside fold {fold}")
        by_label = [_merged(of_label) for of_label in rest.values()]
        models.append(_gaussian(by_label, _scaled(candidate)) if gaussian
                      else _multinomial(by_label, candidate.searched.getSmoothing()))

    def own(values):
        """The value of the row's fold."""
        return F.get(F.lit([float(v) for v in values]), F.col("fold").cast("int"))

    def score(label: int):
        # A label that a fold's rows lack is never predicted.
        absent = (-np.inf, np.zeros(len(names)), np.zeros(len(names)))
        of_fold = [m[label] if label < len(m) else absent for m in models]
        total = own(constant for constant, _, _ in of_fold)
        for j, name in enumerate(names):
            moved = quoted(name) - own(centre[j] for _, centre, _ in of_fold)
            term = moved * own(factor[j] for _, _, factor in of_fold)
            total = total - term * term / 2 if gaussian else total + term
        return total

    # Of equal scores the first label's counts.
    scores = [F.struct(score(i).alias("score"), F.lit(-i).alias("place"))
              for i in range(max(map(len, models)))]
    predicted = -F.array_max(F.array(*scores))["place"]
    hits = {r["fold"]: r["hits"] for r in train.groupBy("fold").agg(
        F.count_if(F.col("label") == predicted).alias("hits")).collect()}
    sizes = {fold: sum(r["n"] for r in cells if r["fold"] == fold) for fold in range(folds)}
    # No rows have no accuracy.
    return [sum(hits[f] / n if n else float("nan") for f, n in sizes.items()) / folds]
