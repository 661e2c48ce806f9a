import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridscale.llm import vectors
from gridscale.llm.vectors import codes, estimate, near_vectors, tables_and_bits


def brute(ids, vecs, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    u = [np.array(v, float) / np.linalg.norm(v) if o else None for v, o in zip(vecs, ok)]
    n = len(ids)
    near = [{j for j in range(n) if j != i and ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine - 1e-12} for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        c = min(ids[j] for j in seen)
        out.append((ids[i], len(near[i]), c, ids[i] == c))
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [base[k % 40] + rng.normal(size=16) * (0.1 if k % 3 else 0.02) for k in range(400)]
    vecs = [[float(x) for x in v] for v in rows] + [[float(x) for x in rows[0]]] * 30
    vecs += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0]]
    ids = list(range(5, 5 + len(vecs)))
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vecs)], "vec_id long, embedding array<double>, class_id int")
    got = sorted(map(tuple, near_vectors(df).collect()))
    want = brute(ids, vecs)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.985 * there <= found <= there and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(df).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(4000, 64))
    u[2000:] = u[:2000] + rng.normal(size=(2000, 64)) * rng.uniform(0, 1, (2000, 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.arange(2000), np.arange(2000, 4000)
    value, radius = estimate(codes(u), i, j, 64)
    true = np.einsum("ij,ij->i", u[i], u[j])
    assert abs((value - true).mean()) < 0.005 and (np.abs(value - true) <= radius).mean() > 0.999


def test_estimates_are_unbiased_over_rotations(monkeypatch):
    """The mean over rotations and roundings comes to the inner product itself, pair by pair."""
    rng = np.random.default_rng(5)
    u = rng.normal(size=(40, 64))
    u[20:] = u[:20] + rng.normal(size=(20, 64)) * 0.4
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.arange(20), np.arange(20, 40)
    rotation, seen = vectors._rotation, []
    for seed in range(400):
        monkeypatch.setattr(vectors, "_rotation", lambda dim, _, s=seed: rotation(dim, 1000 + s))
        seen.append(estimate(codes(u), i, j, 64)[0])
    error = np.mean(seen, axis=0) - np.einsum("ij,ij->i", u[i], u[j])
    assert np.abs(error).max() < 0.03 and abs(error.mean()) < 0.004


def test_recall_at_ten_bits_and_more(spark):
    """All pairs of 70,000 vectors by matrix products against the tables of production size."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(66000, 64)).astype(np.float32)
    near = base[:4000] + rng.normal(size=(4000, 64)).astype(np.float32) * rng.uniform(0.1, 0.5, (4000, 1)).astype(np.float32)
    x = np.vstack([base, near])
    assert tables_and_bits(len(x), 0.9)[1] >= 10
    path = tempfile.mkdtemp(prefix="spark-") + "/vectors.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), path)
    df = spark.read.parquet(path).repartition(8)
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 2000] @ u.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(u), 2000)])
    found = np.array([got[k] for k in range(len(x))])
    assert want.sum() > 4000 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_repeated_ids_and_long_vectors(spark):
    v = [float(k % 17) - 8 for k in range(5000)]
    rows = [(1, v), (1, v), (1, [-x for x in v]), (2, [-x + 1e-3 for x in v]), (None, v), (3, [1.0]), (4, None)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
