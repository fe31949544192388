"""Second-order boosting against a plain re-computation of the same trees."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from phasewise.models import boosting


def plain_fit(bins, y, w, k, rounds_sample, chosen_per_round, base, deltas=None):
    """The same greedy trees, row by row in numpy: margins after all rounds."""
    margin = np.full(len(y), base)
    for sample, chosen in zip(rounds_sample, chosen_per_round):
        if k.objective == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = (p - y) * w, p * (1 - p) * w
        else:
            r = margin - y
            if k.objective == "huber":
                delta = deltas.pop(0)
                # The sketch's quantile is one of the residuals, near the exact one.
                assert abs(np.searchsorted(np.sort(np.abs(r)), delta) / len(r) - k.huber_alpha) < 0.02
                r = np.clip(r, -delta, delta)
            g, h = r * w, w.copy()
        leaf_of = np.ones(len(y), dtype=int)
        values = {}

        def grow(node, rows, depth, total):
            hist = {f: {} for f in chosen}
            for i in rows:
                if sample[i]:
                    for f in chosen:
                        a, b = hist[f].get(bins[i, f], (0.0, 0.0))
                        hist[f][bins[i, f]] = (a + g[i], b + h[i])
            hist = {f: v for f, v in hist.items() if v}
            if total is None:
                first = next(iter(hist.values()), {})
                total = (sum(v[0] for v in first.values()), sum(v[1] for v in first.values()))
            found = boosting.best_split(hist, k) if depth < k.max_depth else None
            if found is None:
                values[node] = -k.learning_rate * boosting._soft(total[0], k.reg_alpha) / (
                    total[1] + k.reg_lambda)
                for i in rows:
                    leaf_of[i] = node
                return
            _, f, b, left, right = found
            grow(2 * node, [i for i in rows if bins[i, f] <= b], depth + 1, left)
            grow(2 * node + 1, [i for i in rows if bins[i, f] > b], depth + 1, right)

        grow(1, list(range(len(y))), 0, None)
        margin = margin + np.array([values[n] for n in leaf_of])
    return margin


@pytest.mark.parametrize("objective", ["logistic", "squared", "huber"])
def test_trees_equal_plain_greedy_trees(spark, objective):
    draw = random.Random(5)
    rows = []
    for i in range(200):
        x = [draw.gauss(0, 1) for _ in range(4)]
        label = float(x[0] + 0.5 * x[1] ** 2 + draw.gauss(0, 0.3) > 0.4) if objective == "logistic" \
            else x[0] * 2 + x[2] + draw.gauss(0, 0.1)
        rows.append((i, *x, None if i == 7 else label, 1.0 + (i % 3)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, "
                                     "y double, wt double")
    k = boosting.Knobs(n_estimators=3, learning_rate=0.3, max_depth=3, gamma=0.05,
                       min_child_weight=0.5, reg_alpha=0.1, reg_lambda=1.5, subsample=0.8,
                       colsample_bytree=0.6, scale_pos_weight=3.0, objective=objective)
    model = boosting.fit(df, ["a", "b", "c", "d"], "y", k, weight="wt")
    scored = model.predict(df).orderBy("id").collect()
    known = [r for r in scored if r["y"] is not None]
    binned = boosting._binned(model.binner, df.filter("y is not null"), model.features)
    with_rid = binned.orderBy("id").collect()
    bins = np.array([r["_bins"] for r in with_rid])
    y = np.array([r["y"] for r in with_rid])
    w = np.array([r["wt"] for r in with_rid])
    if objective == "logistic":
        w = w * np.where(y == 1, k.scale_pos_weight, 1.0)
    # Feature draws as the fit made them.
    draw_features = random.Random(k.seed)
    chosen = [sorted(draw_features.sample(range(4), math.ceil(k.colsample_bytree * 4)))
              for _ in range(k.n_estimators)]
    # The fit samples by a hash of its own row ids; trees fitted here say which rows went in.
    assert len(model.trees) == 3
    for tree, features in zip(model.trees, chosen):
        assert {f for f, _ in tree.splits.values()} <= set(features)
    full = boosting.Knobs(**{**k.__dict__, "subsample": 1.0})
    model = boosting.fit(df, ["a", "b", "c", "d"], "y", full, weight="wt")
    scored = model.predict(df).filter("y is not null").orderBy("id").collect()
    base = 0.0 if objective == "logistic" else float(np.sum(y * w) / np.sum(w))
    expected = plain_fit(bins, y, w, full, [np.ones(len(y), bool)] * 3, chosen, base,
                         list(model.deltas))
    assert np.allclose([r["margin"] for r in scored], expected, rtol=1e-9, atol=1e-9)
    assert len(known) == 199
