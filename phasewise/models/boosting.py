"""Second-order gradient boosting on DataFrames: histograms of gradients and hessians.

Each round fits one regression tree to the first and second derivatives of the loss at the
current margins (logistic loss for classes 0/1, squared error or Huber loss for numbers). Features are cut
into quantile bins once (MLlib's ``QuantileDiscretizer``). Trees grow level by level: one
aggregation per level sums weighted gradients and hessians by (node, feature, bin) over the
rows of the round's sample; the table it returns is bounded by nodes x features x bins, not by
rows, and the split of every node is chosen from it on the driver by the gain

    gain = (T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda)) / 2 - gamma

where T soft-thresholds by alpha. Huber loss takes, each round, the ``huber_alpha`` quantile of
the absolute residuals from a mergeable sketch (``percentile_approx``) as its delta and
clips residuals there; its hessian is the row weight, so leaves step by clipped means. A split needs gain above 0 and a hessian sum of at least
``min_child_weight`` on both sides; a leaf's value is ``-eta * T(G) / (H + lambda)``. Rows
are routed and margins updated by CASE expressions in the JVM; every round is staged, so
lineage stays one round long. The knobs are those of the usual boosted-tree grids:
``n_estimators``, ``learning_rate``, ``max_depth``, ``gamma``, ``min_child_weight``,
``reg_alpha``, ``reg_lambda``, ``subsample`` (rows, by a hash of row and round),
``colsample_bytree`` (features, drawn per tree) and ``scale_pos_weight`` (weight of class 1).
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.session import materialise

MAX_BINS = 64
HUBER_ACCURACY = 10000


@dataclass(frozen=True)
class Knobs:
    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    scale_pos_weight: float = 1.0
    objective: str = "logistic"  # or "squared", "huber"
    huber_alpha: float = 0.9
    seed: int = 7


@dataclass
class Tree:
    """Splits by heap node id (feature, last bin to the left) and leaf values by node id."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)


@dataclass
class Booster:
    features: list[str]
    binner: object
    base: float
    trees: list[Tree]
    objective: str
    deltas: list[float] = field(default_factory=list)

    def margin(self, bins: Column) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _leaf_value(tree, bins)
        return total

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin`` and ``prediction`` (probability of class 1, or the number)."""
        binned = _binned(self.binner, df, self.features)
        out = binned.withColumn("margin", self.margin(F.col("_bins")))
        value = (1 / (1 + F.exp(-F.col("margin")))) if self.objective == "logistic" else F.col("margin")
        return out.withColumn("prediction", value).drop("_bins")


def _binned(binner, df: DataFrame, features: list[str]) -> DataFrame:
    names = [f"_bin_{i}" for i in range(len(features))]
    out = binner.transform(df)
    return out.withColumn("_bins", F.array(*[F.col(n).cast("int") for n in names])).drop(*names)


def _soft(g: float, alpha: float) -> float:
    return math.copysign(max(abs(g) - alpha, 0.0), g)


def _score(g: float, h: float, k: Knobs) -> float:
    return _soft(g, k.reg_alpha) ** 2 / (h + k.reg_lambda)


def best_split(histogram: dict[int, dict[int, tuple[float, float]]], k: Knobs):
    """(gain, feature, bin, left sums, right sums) of the best split of one node, or None.

    ``histogram`` maps feature -> bin -> (gradient sum, hessian sum). Ties go to the smaller
    feature, then the smaller bin.
    """
    best = None
    for feature in sorted(histogram):
        bins = histogram[feature]
        g_all = sum(g for g, _ in bins.values())
        h_all = sum(h for _, h in bins.values())
        parent = _score(g_all, h_all, k)
        g_left = h_left = 0.0
        for b in sorted(bins)[:-1]:
            g_left += bins[b][0]
            h_left += bins[b][1]
            g_right, h_right = g_all - g_left, h_all - h_left
            if h_left < k.min_child_weight or h_right < k.min_child_weight:
                continue
            gain = (_score(g_left, h_left, k) + _score(g_right, h_right, k) - parent) / 2 - k.gamma
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, feature, b, (g_left, h_left), (g_right, h_right))
    return best


def _route(tree: Tree, node: Column, bins: Column, nodes: list[int]) -> Column:
    out = node
    for n in sorted(nodes, reverse=True):
        f, b = tree.splits[n]
        out = F.when(node == n, F.when(bins[f] <= b, 2 * n).otherwise(2 * n + 1)).otherwise(out)
    return out


def _leaf_value(tree: Tree, bins: Column) -> Column:
    """The tree's leaf value for binned rows, as nested CASE expressions from the root."""

    def at(n: int) -> Column:
        if n in tree.leaves:
            return F.lit(tree.leaves[n])
        f, b = tree.splits[n]
        return F.when(bins[f] <= b, at(2 * n)).otherwise(at(2 * n + 1))

    return at(1)


def _in_sample(rid: Column, round_: int, k: Knobs) -> Column:
    if k.subsample >= 1:
        return F.lit(True)
    draw = F.pmod(F.xxhash64(rid, F.lit(round_), F.lit(k.seed)), F.lit(1 << 30)) / float(1 << 30)
    return draw < k.subsample


def fit(df: DataFrame, features: list[str], label: str, k: Knobs = Knobs(),
        weight: str | None = None) -> Booster:
    """A booster for ``label`` from the double columns ``features`` of ``df``.

    Rows with a null label take no part; null or NaN features fall into a bin of their own.
    With ``weight``, rows count by that column; class 1 counts ``scale_pos_weight`` times more.
    """
    names = [f"_bin_{i}" for i in range(len(features))]
    binner = QuantileDiscretizer(numBuckets=MAX_BINS, inputCols=features, outputCols=names,
                                 handleInvalid="keep", relativeError=1e-4).fit(
        df.filter(F.col(label).isNotNull()))
    y = F.col(label).cast("double")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    if k.objective == "logistic":
        w = w * F.when(y == 1, F.lit(float(k.scale_pos_weight))).otherwise(F.lit(1.0))
    rows = _binned(binner, df.filter(F.col(label).isNotNull()), features).select(
        F.monotonically_increasing_id().alias("rid"), "_bins", y.alias("y"), w.alias("w"))
    rows = materialise(rows, "boost-rows")
    if k.objective == "logistic":
        base = 0.0
    else:
        base = rows.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0] or 0.0
    rows = rows.withColumn("margin", F.lit(float(base)))
    draw = random.Random(k.seed)
    trees, deltas = [], []
    for round_ in range(k.n_estimators):
        chosen = sorted(draw.sample(range(len(features)),
                                    max(1, math.ceil(k.colsample_bytree * len(features)))))
        delta = huber_delta(rows, k) if k.objective == "huber" else None
        tree = _grow(rows, round_, chosen, k, delta)
        trees.append(tree)
        deltas += [delta] if delta is not None else []
        rows = materialise(rows.withColumn("margin", F.col("margin") + _leaf_value(
            tree, F.col("_bins"))), "boost-rows")
    return Booster(features, binner, float(base), trees, k.objective, deltas)


def huber_delta(rows: DataFrame, k: Knobs) -> float:
    """The ``huber_alpha`` quantile of absolute residuals, from a mergeable sketch."""
    residual = F.abs(F.col("y") - F.col("margin"))
    found = rows.agg(F.percentile_approx(residual, k.huber_alpha, HUBER_ACCURACY)).first()[0]
    return float(found or 0.0)


def _derivatives(k: Knobs, delta: float | None = None) -> tuple[Column, Column]:
    if k.objective == "logistic":
        p = 1 / (1 + F.exp(-F.col("margin")))
        return (p - F.col("y")) * F.col("w"), p * (1 - p) * F.col("w")
    residual = F.col("margin") - F.col("y")
    if k.objective == "huber":
        residual = F.greatest(F.least(residual, F.lit(delta)), F.lit(-delta))
    return residual * F.col("w"), F.col("w")


def _grow(rows: DataFrame, round_: int, chosen: list[int], k: Knobs,
          delta: float | None = None) -> Tree:
    g, h = _derivatives(k, delta)
    sample = rows.filter(_in_sample(F.col("rid"), round_, k)).select(
        "_bins", g.alias("g"), h.alias("h"), F.lit(1).alias("node"))
    tree, open_nodes, sums = Tree(), [1], {}
    for depth in range(k.max_depth + 1):
        if not open_nodes:
            break
        if depth == k.max_depth:  # the last children's sums came with their parents' splits
            for n in open_nodes:
                tree.leaves[n] = -k.learning_rate * _soft(sums[n][0], k.reg_alpha) / (
                    sums[n][1] + k.reg_lambda)
            break
        wanted = F.col("f").isin(chosen)
        histogram = (sample.filter(F.col("node").isin(open_nodes))
                     .select("node", F.posexplode("_bins").alias("f", "bin"), "g", "h")
                     .filter(wanted).groupBy("node", "f", "bin")
                     .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
        by_node: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in histogram:
            by_node.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
        split_now = []
        for n in open_nodes:
            features = by_node.get(n, {})
            first = next(iter(features.values()), {})
            total = sums.get(n) or (sum(v[0] for v in first.values()),
                                    sum(v[1] for v in first.values()))
            found = best_split(features, k)
            if found is None:
                tree.leaves[n] = -k.learning_rate * _soft(total[0], k.reg_alpha) / (
                    total[1] + k.reg_lambda)
                continue
            _, f, b, left, right = found
            tree.splits[n] = (f, b)
            sums[2 * n], sums[2 * n + 1] = left, right
            split_now.append(n)
        if split_now:
            sample = sample.withColumn("node", _route(tree, F.col("node"), F.col("_bins"),
                                                      split_now))
        open_nodes = [c for n in split_now for c in (2 * n, 2 * n + 1)]
    return tree
