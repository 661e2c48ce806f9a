import itertools

import numpy as np
import pandas as pd
import pytest

from gridscale.operators import train
from gridscale.operators.boost import FAMILIES, Booster, Boosting, BoostModel, Params, best_split, leaf_value, split_gains
from gridscale.operators.gradient import Network, svr
from gridscale.operators.trees import trees_of
from gridscale.sources.files import load_models, save_models


def table(spark, x, y, names):
    return spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])).repartition(3)


def brute(x, g, p, depth, tried):
    """The tree by trying every threshold of every feature on the rows themselves."""
    score = lambda v: max(abs(v.sum()) - p.l1, 0) ** 2 / (len(v) + p.l2)
    best = (1e-12, None)
    if depth < p.depth:
        for f in range(x.shape[1]):
            for t in tried[f]:
                low = x[:, f] < t
                if min(low.sum(), (~low).sum()) >= max(p.least_rows, p.least_weight):
                    gain = 0.5 * (score(g[low]) + score(g[~low]) - score(g)) - p.least_gain
                    if gain > best[0] + 1e-9 * abs(gain):
                        best = (gain, (f, t))
    if best[1] is None:
        return float(p.rate * leaf_value(g.sum(), float(len(g)), p))
    f, t = best[1]
    low = x[:, f] < t
    return (f, float(t), brute(x[low], g[low], p, depth + 1, tried), brute(x[~low], g[~low], p, depth + 1, tried))


def nested(t, k=0):
    return float(t.value[k]) if t.left[k] < 0 else (int(t.feature[k]), float(t.threshold[k]), nested(t, t.left[k]), nested(t, t.right[k]))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-9
    return a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and same(a[2], b[2]) and same(a[3], b[3])


@pytest.mark.parametrize("p", [Params(depth=3, bins=256), Params(depth=3, bins=256, l1=2.0, l2=5.0, least_gain=1.0, least_rows=6, most_step=1.5)])
def test_first_tree_equals_a_split_search_over_rows(spark, p):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (150, 3)).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 9, 5 * x[:, 2], 0) + rng.integers(0, 5, 150)
    fit = Boosting(table(spark, x, y, "abc"), list("abc"), p)
    tree = fit.finished(fit.grow(0, fit._gradients()))[2]
    assert same(nested(tree), brute(x, y.mean() - y, p, 0, [np.unique(x[:, f])[1:] for f in range(3)]))


def test_leaves_open_by_gain(spark):
    """Leaf by leaf, a tree has the leaves that a plain queue of gains opens first."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = np.where(x[:, 0] > 6, 40 * np.sin(x[:, 1]), 2 * x[:, 2])
    p = Params(grow="leafwise", leaves=7, depth=0, bins=256)
    fit = Boosting(table(spark, x, y, "abc"), list("abc"), p)
    tree = fit.finished(fit.grow(0, fit._gradients()))[2]
    g = y.mean() - y
    edges = [np.unique(x[:, k])[1:] for k in range(3)]

    def sums(rows):
        out = np.zeros((3, 13, 3))
        for k in range(3):
            b = np.searchsorted(edges[k], x[rows, k], side="right")
            for j, v in enumerate((g[rows], np.ones(rows.sum()), np.ones(rows.sum()))):
                out[k, :, j] = np.bincount(b, weights=v, minlength=13)
        return out

    leaves = [np.ones(300, bool)]
    while len(leaves) < 7:
        found = [best_split(split_gains(sums(r), p)) for r in leaves]
        k = max(range(len(leaves)), key=lambda k: found[k][0])
        _, f, b = found[k]
        low = x[:, f] < edges[f][b]
        leaves[k : k + 1] = [leaves[k] & low, leaves[k] & ~low]
    want = np.zeros(300)
    for r in leaves:
        want[r] = p.rate * leaf_value(g[r].sum(), r.sum(), p)
    assert (tree.left < 0).sum() == 7 and np.abs(tree.predict(x) - want).max() < 1e-9


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4)).round(2)
    return x, 3 * x[:, 0] + np.where(x[:, 1] > 0, 5, 0) * x[:, 2] + rng.normal(size=1500) * 0.1


def test_families_fit_and_differ(spark, made, tmp_path):
    x, y = made
    df, models = table(spark, x, y, "abcd"), {}
    for family in FAMILIES:
        models[family] = Booster(list("abcd"), family, rounds=6).fit(df)
        assert 1 - ((models[family].predict(x) - y) ** 2).mean() / y.var() > 0.7
    models["dart"] = Booster(list("abcd"), "lgb", rounds=5, drop=0.5, skip_drop=0.0).fit(df)
    assert any(s < 1 for s in models["dart"].scales)
    for a, b in itertools.combinations(models, 2):
        assert np.abs(models[a].predict(x) - models[b].predict(x)).max() > 0.1
    cat = models["catb"].trees[0]
    assert len({(f, t) for f, t, n in zip(cat.feature, cat.threshold, cat.left) if n >= 0}) <= cat.depth  # one split a level
    save_models(models, str(tmp_path / "m"))
    again, _ = load_models(spark, str(tmp_path / "m"))
    assert all(isinstance(m, BoostModel) and (m.predict(x) == models[n].predict(x)).all() for n, m in again.items())
    told = models["xgb"].transform(df).toPandas()
    assert np.abs(told["prediction"] - models["xgb"].predict(told[list("abcd")].to_numpy())).max() < 1e-12


def test_sums_so_far_are_written_between_trees(spark, made):
    x, y = made
    df = table(spark, x[:400], y[:400], "abcd")
    a, b = (Booster(list("abcd"), "catb", rounds=4, refresh=r).fit(df) for r in (2, 99))
    assert np.abs(a.predict(x) - b.predict(x)).max() < 1e-9
    assert trees_of(a)[2] == a.base and len(trees_of(a)[0]) == 4


def test_edge_tables(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 3.0), (2.0, 1.0, 3.0), (3.0, float("nan"), 1.0)], "a double, b double, y double")
    m = Booster(["a", "b"], rounds=2).fit(df)
    assert m.base == 3.0 and all(len(t.left) == 1 for t in m.trees) and m.transform(df).count() == 2
    with pytest.raises(ValueError, match="no complete rows"):
        Booster(["a", "b"]).fit(df.where("false"))
    with pytest.raises(ValueError, match="no parameters"):
        Booster(["a"], no_such=1)


def test_kernel_fit_learns_a_ring(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 2))
    y = np.where((x**2).sum(axis=1) < 1.2, 3.0, 0.0)
    df = table(spark, x, y, "ab")
    r2 = lambda m: 1 - ((m.predict(x) - y) ** 2).mean() / y.var()
    assert r2(svr(["a", "b"]).fit(df, rounds=8, rate=0.08)) < 0.1 < 0.5 < r2(svr(["a", "b"], fourier=200).fit(df, rounds=20, rate=0.08))
    m = svr(["a", "b"], fourier=4000, gamma=0.5)
    z, k = m.lifted(x[:60]), np.exp(-0.5 * ((x[:60, None] - x[None, :60]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - k).max() < 5 / np.sqrt(4000)


def test_network_of_many_units_in_mini_batches(spark, made):
    x, y = made
    df = table(spark, x, y, "abcd")
    m = Network(list("abcd"), (512, 256, 128)).fit(df, rounds=4, rate=0.003, batch_rows=300)
    assert len(m.weights) > 160_000 and 1 - ((m.predict(x) - y) ** 2).mean() / y.var() > 0.8
    rows = np.column_stack([x[:50], y[:50]])
    small = Network(list("abcd"), (5, 3))
    at, step = small.weights + np.random.default_rng(5).normal(size=len(small.weights)) * 0.1, 1e-6  # off the units' kinks
    g, _ = small._gradient(at, rows[:, :4], rows[:, 4])
    for k in np.random.default_rng(0).integers(0, len(at), 12):
        e = np.zeros(len(at))
        e[k] = step
        assert (small._gradient(at + e, rows[:, :4], rows[:, 4])[1] - small._gradient(at - e, rows[:, :4], rows[:, 4])[1]) / 2 / step == pytest.approx(g[k], rel=1e-4, abs=1e-5)


def test_every_family_is_stored_and_read(spark, made, tmp_path):
    x, y = made
    df = table(spark, x[:300], y[:300], "abcd")
    done, failed = train.trained(df, list("abcd"), [*train.DEFAULTS, "unheard_of"], {n: {"rounds": 2} for n in ("xgb", "lgb", "catb", "nn", "svr")} | {"rf": {"numTrees": 2}, "gbr": {"maxIter": 2}})
    assert set(done) == set(train.DEFAULTS) and set(failed) == {"unheard_of"}
    save_models(done, str(tmp_path / "m"))
    again, _ = load_models(spark, str(tmp_path / "m"))
    for name in done:
        a, b = (m[name].transform(df).select("a", "b", "prediction").toPandas().sort_values(["a", "b"]) for m in (done, again))
        assert np.allclose(a["prediction"], b["prediction"]), name
