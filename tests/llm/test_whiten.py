import math
from fractions import Fraction

import numpy as np
import pytest

from gridscale.llm.queries import op11_whitening
from gridscale.llm.whiten import components_of, polar, whiten


def test_polar_factor():
    rng = np.random.default_rng(2)
    for m in (1, 2, 5, 40):
        a = rng.normal(size=(m, m))
        a = a + a.T
        e, q = np.linalg.eigh(a)
        assert np.allclose(polar(a), q * np.sign(e) @ q.T, atol=1e-10 / np.abs(e).min())


@pytest.mark.parametrize("kind", range(6))
def test_components_against_a_library(kind):
    rng = np.random.default_rng(kind)
    for _ in range(30):
        m, n = int(rng.integers(1, 66)), int(rng.integers(1, 200))
        x = rng.integers(-300, 300, (n, m)).astype(float)
        if kind == 1:
            x[:] = x[:, :1]
        elif kind == 2:
            x = np.round(x * np.logspace(0, -4, m))
        elif kind == 3:
            x = np.eye(m) * 256  # equal eigenvalues
        elif kind == 4:
            x[:, : m // 2] = x[:, m - m // 2 :]
        elif kind == 5:
            x[:] = 7
        x -= x.mean(axis=0)
        v = x.T @ x / len(x)
        e, q = components_of(v)
        size = max(np.abs(v).max(), 1e-300)
        assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-12 * size
        assert np.abs(q.T @ q - np.eye(m)).max() <= 1e-12 and np.abs(v @ q - q * e).max() <= 1e-12 * size


def plain(rows, components=4):
    """The contract in plain Python and numpy, for vectors of one length."""
    use = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in use})
    n, dim = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(dim)]
    y = np.array([[float(Fraction(n * x[k] - s[k], n)) for k in range(dim)] for x in fit])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in use:
        d = np.array([float(Fraction(n * x[k] - s[k], n)) for k in range(dim)])
        dev = sum((n * x[k] - s[k]) ** 2 for k in range(dim))
        out += [(i, k + 1, n, dev, d @ q[:, k] / math.sqrt(e[k]), e[k] / np.trace(v)) for k in range(min(components, dim))]
    return out


def compare(got, want):
    got = sorted(got, key=lambda r: (-1 if r.vec_id is None else r.vec_id, r.component, r.deviation, abs(r.whitened)))
    want = sorted(want, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[3], abs(r[4])))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    for c in {r.component for r in got}:
        a, b = np.array([r.whitened for r in got if r.component == c]), np.array([r[4] for r in want if r[1] == c])
        sign = 1 if np.abs(a - b).max() < np.abs(a + b).max() else -1
        assert np.abs(a - sign * b).max() < 1e-8
    assert all(abs(r.explained - w[5]) < 1e-9 for r, w in zip(got, want, strict=True))
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_query_against_plain_form(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op11_whitening(spark, sf).collect(), plain(rows))


def test_nulls_copies_and_odd_entries(spark):
    rng = np.random.default_rng(0)
    good = [(k, rng.normal(size=6).tolist(), 1) for k in range(60)]
    rows = good + [(k + 100, v, 1) for k, v, _ in good[:30]] + [(200, None, 1), (201, [0.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] + [0.0] * 5, 1), (203, [float("inf")] * 6, 1), (204, [], 1), (None, good[0][1], 1), (5, good[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int").repartition(7)
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows]
    compare(whiten(df).collect(), plain(as_float))


def test_lengths_ties_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [1.0]), (5, [-0.0, 0.0, 0.0])]
    got = {(r.vec_id, r.component): r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1), (5, 2), (5, 3)}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None and got[1, 1].n == 2 and got[1, 1].deviation == 512**2
    assert got[3, 1].n == 1 and got[3, 1].whitened is None and got[3, 1].explained == 0 and got[3, 1].deviation == 0
    corners = [(k, [float(k == j) for j in range(5)]) for k in range(5)]  # four equal eigenvalues
    out = whiten(spark.createDataFrame(corners, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 20 and all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-9 for r in out)
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_entries(spark):
    make = lambda size: [(k, [float(k % 7) * size, float(k)]) for k in range(50)]
    for size in (100, 1e4):
        compare(whiten(spark.createDataFrame(make(size), "vec_id long, embedding array<double>")).collect(), plain(make(size)))
    with pytest.raises(Exception, match="does not fit a long"):
        whiten(spark.createDataFrame(make(1e9), "vec_id long, embedding array<double>")).collect()
