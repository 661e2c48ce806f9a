import itertools
from math import factorial

import numpy as np
import pandas as pd

from gridscale.operators import train
from gridscale.operators.shap import attributions, pair_interactions, paths_of, tree_attributions, tree_interactions
from gridscale.operators.trees import Tree, trees_of


def expected(tree, x, known, k=0):
    """The tree's mean with the features ``known``, by walking it with the cover of its nodes."""
    if tree.left[k] < 0:
        return tree.value[k]
    if tree.feature[k] in known:
        v = x[tree.feature[k]]
        low = v <= tree.threshold[k] if tree.closed else v < tree.threshold[k]
        return expected(tree, x, known, tree.left[k] if low else tree.right[k])
    a, b = tree.left[k], tree.right[k]
    return (tree.cover[a] * expected(tree, x, known, a) + tree.cover[b] * expected(tree, x, known, b)) / tree.cover[k]


def enumerated(trees, weights, base, x, n):
    v = {}
    for r in range(n + 1):
        for s in itertools.combinations(range(n), r):
            v[frozenset(s)] = base + sum(w * expected(t, x, s) for t, w in zip(trees, weights, strict=True))
    phi, inter = np.zeros(n), np.zeros((n, n))
    for i in range(n):
        for s in v:
            if i not in s:
                phi[i] += factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (v[s | {i}] - v[s])
            for j in range(n):
                if i != j and i not in s and j not in s:
                    inter[i, j] += factorial(len(s)) * factorial(n - len(s) - 2) / factorial(n - 1) / 2 * (v[s | {i, j}] - v[s | {i}] - v[s | {j}] + v[s])
    inter[np.arange(n), np.arange(n)] = phi - inter.sum(axis=1)
    return phi, inter, v[frozenset()]


def made_tree(rng, n, depth, closed):
    rows = {c: [] for c in ("feature", "threshold", "left", "right", "value", "cover")}

    def add(level, cover):
        k = len(rows["left"])
        for c, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", rng.normal()), ("cover", cover)):
            rows[c].append(v)
        if level < depth and cover > 3 and rng.random() < 0.9:
            rows["feature"][k], rows["threshold"][k] = int(rng.integers(n)), float(rng.integers(1, 9))
            part = int(rng.integers(1, cover))
            rows["left"][k] = add(level + 1, part)
            rows["right"][k] = add(level + 1, cover - part)
        return k

    add(0, 200)
    return Tree(*[np.array(v) for v in rows.values()], closed)


def test_equal_to_enumeration_of_all_coalitions():
    rng = np.random.default_rng(0)
    for closed in (True, False):
        trees, weights = [made_tree(rng, 5, d, closed) for d in (0, 2, 4, 6)], [0.5, 1.0, -2.0, 0.25]
        assert max(p.feature.shape[1] for t in trees for p in paths_of(t)) >= 3
        x = rng.integers(0, 10, (12, 5)).astype(float)
        phi, start = attributions(trees, weights, 1.5, x, 5)
        inter = pair_interactions(trees, weights, x, 5)
        for r in range(len(x)):
            want, pairs, first = enumerated(trees, weights, 1.5, x[r], 5)
            assert np.abs(phi[r] - want).max() < 1e-9 and np.abs(inter[r] - pairs).max() < 1e-9 and abs(start - first) < 1e-9
        assert np.abs(inter.sum(axis=2) - phi).max() < 1e-9


def test_models_of_spark_and_of_this_library(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)).round(1)
    y = x[:, 0] + 6 * x[:, 1] * x[:, 2]
    df = spark.createDataFrame(pd.DataFrame({"sample_id": [str(k) for k in range(400)], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(3)
    for name, params in (("rf", {"numTrees": 3, "maxDepth": 4}), ("gbr", {"maxIter": 3}), ("lgb", {"rounds": 3})):
        model = train.pipeline(name, list("abc"), **params).fit(df)
        phi, base = tree_attributions(model, df, list("abc"))
        got = phi.groupBy("sample_id").sum("phi").toPandas().set_index("sample_id")["sum(phi)"] + base
        told = model.transform(df).select("sample_id", "prediction").toPandas().set_index("sample_id")["prediction"]
        assert np.abs(got - told.loc[got.index]).max() < 1e-9 and len(got) == 400, name
        assert len(trees_of(model)[0]) == 3
    strength = {(r.a, r.b): r.strength for r in tree_interactions(model, df, list("abc")).collect()}
    assert set(strength) == {("a", "b"), ("a", "c"), ("b", "c")} and strength["b", "c"] == max(strength.values())
