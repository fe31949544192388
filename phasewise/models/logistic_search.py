"""Cross-validation of ridge logistic regressions, all grid points and folds side by side.

The grid of a logistic regression has one penalty per point, and the rows are the same for all
of them, so nothing is gained by a job per point, fold and iteration. Here every pass over the
training rows sums the loss, gradient and Hessian of all models that are still moving: one
model per fold, point and, against the rest, class. The sums are added up by Spark; what
reaches the driver is bounded by models x features x features, and there each model takes its
Newton step, halved while the loss would grow. The loss is that of
MLlib's ``LogisticRegression`` without standardisation: the weighted mean log loss plus
``regParam / 2`` times the squared coefficients, the intercept left out. It has one minimum,
which Newton reaches in a few passes.

As in a search by single fits, features are centred and divided by the population deviation of
the fold's training rows; a feature that is constant there counts for nothing, and a label that
all of them share (or none) is always (or never) predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows worked on at once; when a model is at its minimum; deviations that count
# as none, of features whose deviation over all folds is 1.
CHUNK = 2048
TOLERANCE = 1e-12
CONSTANT = 1e-9


def _per_cell(rows: DataFrame, sums) -> dict[int, float]:
    """``sums`` maps arrays of rows to an array of numbers; each number added over all rows."""

    def run(batches):
        total = None
        for batch in batches:
            fold, label, weight = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(len(fold), -1)
            for at in range(0, len(fold), CHUNK):
                part = slice(at, at + CHUNK)
                found = sums(np.column_stack([x[part], np.ones(len(x[part]))]), fold[part],
                             label[part], weight[part])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())],
                ["cell", "value"])

    cells = rows.mapInArrow(run, "cell long, value double")
    return {r["cell"]: r["value"]
            for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def _array(cells: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros(size)
    out[list(cells)] = list(cells.values())
    return out


def _derivatives(rows: DataFrame, models: np.ndarray, held: np.ndarray, target: np.ndarray):
    """Sums of loss, gradient and Hessian of each model over the rows outside its fold."""
    count, size = models.shape
    above = np.triu_indices(size)

    def sums(x, fold, label, weight):
        margin = x @ models.T
        small = np.exp(-np.abs(margin))
        chance = np.where(margin >= 0, 1.0, small) / (1.0 + small)
        wanted = label[:, None] == target
        counted = weight[:, None] * (fold[:, None] != held)
        loss = (counted * (np.log1p(small) + np.maximum(margin, 0) - margin * wanted)).sum(0)
        gradient = (counted * (chance - wanted)).T @ x
        curve = (counted * chance * (1 - chance)).T @ (x[:, above[0]] * x[:, above[1]])
        return np.concatenate([loss, gradient.ravel(), curve.ravel()])

    ends = np.cumsum([count, count * size, count * len(above[0])])
    found = _array(_per_cell(rows, sums), ends[-1])
    curve = np.zeros((count, size, size))
    curve[:, above[0], above[1]] = found[ends[1]:].reshape(count, -1)
    curve[:, above[1], above[0]] = found[ends[1]:].reshape(count, -1)
    return found[:count], found[ends[0]:ends[1]].reshape(count, size), curve


def _minima(rows: DataFrame, start: np.ndarray, to_raw: np.ndarray, held, target, total,
            penalty, passes: int) -> np.ndarray:
    """Coefficients, intercept last, of each model's least loss, for the rows as they are.

    ``to_raw`` leads from a model's own scaled features to those of the rows, ``total`` is the
    weight of its training rows.
    """
    own = start.copy()
    ridge = np.zeros_like(own)
    ridge[:, :-1] = penalty[:, None]
    at_loss = np.full(len(own), np.inf)
    step, length = np.zeros_like(own), np.ones(len(own))
    moving = np.arange(len(own))
    for _ in range(passes):
        if not len(moving):
            break
        tried = own[moving] + length[moving, None] * step[moving]
        turn = to_raw[moving]
        loss, gradient, curve = _derivatives(
            rows, np.einsum("mij,mj->mi", turn, tried), held[moving], target[moving])
        share, ridges = total[moving], ridge[moving]
        loss = loss / share + (ridges * tried**2).sum(1) / 2
        gradient = np.einsum("mij,mi->mj", turn, gradient) / share[:, None] + ridges * tried
        curve = np.einsum("mij,mik,mkl->mjl", turn, curve, turn) / share[:, None, None]
        # A saturated model has no curvature left in its intercept.
        curve[:, np.arange(own.shape[1]), np.arange(own.shape[1])] += np.maximum(ridges, 1e-14)
        better = loss <= at_loss[moving] * (1 + 1e-12)
        there, worse = moving[better], moving[~better]
        own[there], at_loss[there], length[there] = tried[better], loss[better], 1.0
        step[there] = -np.linalg.solve(curve[better], gradient[better][..., None])[..., 0]
        length[worse] /= 2
        gain = -(gradient[better] * step[there]).sum(1) / 2
        done = there[gain <= TOLERANCE]
        moving = np.setdiff1d(moving, np.concatenate([done, worse[length[worse] < 1e-6]]))
    return np.einsum("mij,mj->mi", to_raw, own)


def search(train: DataFrame, build, folds: int, classes: int) -> list[float]:
    """Mean accuracy over the folds of each point of the grid that ``build(rows)`` gives.

    With three classes or more, a model per class is fitted against the rest and the largest
    margin is predicted.
    """
    candidate = build(train.count())
    prepared = candidate.preparation.fit(train).transform(train)
    rows = prepared.select(
        F.col("fold").cast("long"), F.col("label").cast("double"),
        F.col("weight").cast("double"), vector_to_array("features").alias("x")).persist()
    size = len(rows.first()["x"])
    moments = rows.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"),
        F.array(*[F.avg(F.get("x", F.lit(j))) for j in range(size)]).alias("mean"),
        F.array(*[F.var_pop(F.get("x", F.lit(j))) for j in range(size)]).alias("spread"),
    ).collect()
    wanted = [1.0] if classes == 2 else [float(c) for c in range(classes)]
    models = []  # fold, class, penalty, weight, turn to the rows' features, constant label
    for fold in range(folds):
        rest = [r for r in moments if r["fold"] != fold]
        n = np.array([r["n"] for r in rest], dtype=float)
        mean = n @ np.array([r["mean"] for r in rest]) / n.sum()
        away = np.array([r["mean"] for r in rest]) - mean
        deviation = np.sqrt(n @ (np.array([r["spread"] for r in rest]) + away**2) / n.sum())
        factor = np.where(deviation > CONSTANT, 1 / np.maximum(deviation, CONSTANT), 0.0)
        turn = np.diag([*factor, 1.0])
        turn[-1, :-1] = -mean * factor
        of_fold = build(int(n.sum()))
        for point in of_fold.grid:
            for c in wanted:
                hits = sum(r["n"] for r in rest if r["label"] == c)
                constant = np.inf if hits == n.sum() else -np.inf if hits == 0 else 0.0
                models.append((fold, c, point[of_fold.searched.regParam],
                               sum(r["w"] for r in rest), turn, constant))
    held, target, penalty, total, to_raw, constant = map(np.array, zip(*models))
    raw = np.zeros((len(models), size + 1))
    raw[:, -1] = constant
    fitted = np.flatnonzero(constant == 0)
    raw[fitted] = _minima(rows, np.zeros((len(fitted), size + 1)), to_raw[fitted], held[fitted],
                          target[fitted], total[fitted], penalty[fitted],
                          candidate.searched.getMaxIter())

    def right(x, fold, label, weight):
        margin = (x @ raw.T).reshape(len(x), -1, len(wanted))
        predicted = (margin[..., 0] > 0) if classes == 2 else margin.argmax(-1)
        return ((predicted == label[:, None]) & (fold[:, None] == held[::len(wanted)])).sum(0) * 1.0

    points = len(candidate.grid)
    hits = _array(_per_cell(rows, right), folds * points).reshape(folds, points)
    rows.unpersist()
    sizes = np.array([sum(r["n"] for r in moments if r["fold"] == f) for f in range(folds)])
    with np.errstate(invalid="ignore"):
        return list((hits / sizes[:, None]).mean(0).tolist())
