"""Whitening of vectors by principal components from QDWH spectral divide-and-conquer.

1. Entries become whole numbers floor(scale x c). Distinct rows are the fit list: rows are dealt by a 64-bit hash and
   compared in full.
2. One pass gives n and exact sums S, a second one exact sums of products of what is left after the whole number next
   to the mean is taken off, so the covariance doesn't depend on the order of rows or tasks.
3. The covariance, dim x dim numbers, is split in the driver: the polar factor of V - shift x I, found by the dynamically
   weighted Halley iteration in its QR form, gives the projectors on the eigenvectors above and below the shift; each
   invariant subspace is split again until single components are left.
4. The components, dim x ``components`` numbers, go to all tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, COMPONENTS = 256, 4
#: Whole numbers of doubles up to here have exact sums.
EXACT = 1 << 53
_EPS = np.finfo(float).eps
_LONG = np.iinfo(np.int64).max


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = max(np.linalg.norm(x, -2) * 0.9, _EPS)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        f = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0.0))
        g = (f - 1) ** 2 / 4
        c = f + g - 1
        q, _r = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(m)]))
        new = g / c * x + (f - g / c) / np.sqrt(c) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (f + g * low**2) / (1 + c * low**2), 1.0)
        if moved < 4 * np.cbrt(_EPS) and abs(1 - low) < 1e-9 or moved < 10 * _EPS * np.sqrt(m):
            break
    return x


def _subspaces(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the parts on which the polar factor ``u`` is 1 and -1."""
    m = len(u)
    above = (np.eye(m) + u) / 2
    k = int(round(np.trace(above)))
    if k in (0, m):
        return (np.eye(m), np.zeros((m, 0))) if k else (np.zeros((m, 0)), np.eye(m))
    # columns of the projector by falling weight, orthogonalised twice, then the rest of the space
    columns = above[:, np.argsort(-np.diag(above), kind="stable")]
    basis = np.zeros((m, 0))
    for _ in range(k):
        left = columns - basis @ (basis.T @ columns)
        left -= basis @ (basis.T @ left)
        size = np.linalg.norm(left, axis=0)
        basis = np.column_stack([basis, left[:, size.argmax()] / size.max()])
    q, _r = np.linalg.qr(above @ basis)  # one step of subspace iteration
    full, _r = np.linalg.qr(np.hstack([q, np.eye(m)]))
    return full[:, :k], full[:, k:]


def spectral_parts(v: np.ndarray, scale: float | None = None) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix, as columns in no order; equal eigenvalues give any basis."""
    m = len(v)
    scale = np.linalg.norm(v) if scale is None else scale
    off = v - np.diag(np.diag(v))
    if m <= 1 or np.linalg.norm(off) <= 4 * _EPS * scale:
        return np.eye(m)
    if m == 2:  # one rotation
        angle = 0.5 * np.arctan2(2 * v[0, 1], v[0, 0] - v[1, 1])
        c, s = np.cos(angle), np.sin(angle)
        return np.array([[c, -s], [s, c]])
    d = np.diag(v)
    for shift in (np.median(d), d.mean(), (d.max() + d.min()) / 2, *np.quantile(d, [0.35, 0.65, 0.2, 0.8])):
        moved = v - shift * np.eye(m)
        if not moved.any():
            continue
        upper, lower = _subspaces(polar(moved))
        if 0 < upper.shape[1] < m and np.linalg.norm(upper.T @ v @ lower) <= 1e3 * _EPS * m * scale:
            halves = []
            for basis in (upper, lower):
                own = basis.T @ v @ basis
                halves.append(basis @ spectral_parts((own + own.T) / 2, scale))
            return np.hstack(halves)
    q, _r = np.linalg.qr(_jacobi(v))  # no shift parts a cluster of nearly equal eigenvalues: rotations do
    return q


def _jacobi(v: np.ndarray) -> np.ndarray:
    a, m = v.copy(), len(v)
    q = np.eye(m)
    for _ in range(30):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= _EPS * np.linalg.norm(a):
            break
        for i in range(m - 1):
            for j in range(i + 1, m):
                if a[i, j]:
                    angle = 0.5 * np.arctan2(2 * a[i, j], a[j, j] - a[i, i])
                    c, s = np.cos(angle), np.sin(angle)
                    turn = np.array([[c, s], [-s, c]])
                    a[:, [i, j]] = a[:, [i, j]] @ turn
                    a[[i, j]] = turn.T @ a[[i, j]]
                    q[:, [i, j]] = q[:, [i, j]] @ turn
    return q


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors as columns."""
    if not v.any():
        return np.zeros(len(v)), np.eye(len(v))
    q = spectral_parts(v)
    for _ in range(2):  # first-order correction of what rounding left, once the parts are apart
        t = q.T @ v @ q
        e = np.diag(t)
        gap = e[None, :] - e[:, None]
        small = np.abs(gap) < 1e-6 * np.abs(e).max()
        q, _r = np.linalg.qr(q + q @ np.where(small, 0.0, t / np.where(small, 1.0, gap)))
    e = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance above what rounding leaves."""
        return self.values > 1e-13 * max(self.trace, 0.0) if self.n else np.zeros(0, dtype=bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = [Fraction(s, self.n) for s in self.sums]
        near = np.array([round(m) for m in mean], dtype=np.int64)
        rest = np.array([float(m - int(k)) for m, k in zip(mean, near, strict=True)])
        y = (x - near).astype(float) - rest
        e = np.where(self.usable, self.values, np.nan)
        return y @ self.vectors / np.sqrt(e)


def _numbers(column, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that can be used, and their whole numbers."""
    rows, xs = [], []
    for k, v in enumerate(column):
        if v.is_valid and v.values.null_count == 0:
            c = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if np.isfinite(c).all():
                x = np.floor(scale * c)
                if (np.abs(x) >= float(1 << 62)).any():
                    raise OverflowError("an entry's whole number does not fit a long")
                rows.append(k)
                xs.append(x.astype(np.int64))
    return np.array(rows, dtype=np.int64), xs


def _longs(x: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(v) for v in x])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)))


def whole_numbers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): rows whose vector is neither null nor empty nor holds null or non-finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _numbers(b.column(1), scale)
            keep = [k for k, v in enumerate(x) if len(v)]
            x = [x[k] for k in keep]
            if x:
                ids = b.column(0).take(pa.array(rows[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(v) for v in x], pa.int32()), _longs(x)], ["vec_id", "dim", "x"])

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "vec_id long, dim int, x array<long>")


def _by_dim(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of the vectors of each length in each batch, a few MB at a time."""
    for b in batches:
        dims = b.column(b.schema.get_field_index("dim")).to_numpy()
        x = b.column(b.schema.get_field_index(column))
        flat, ends = x.flatten().to_numpy(), np.r_[0, np.cumsum(dims.astype(np.int64))]
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            step = max(1, (1 << 20) // int(d))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                yield int(d), flat[(ends[some][:, None] + np.arange(d)[None, :])]


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers, as Python numbers beyond doubles."""
    most = int(np.abs(y).max(initial=0))
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    if most * most >= EXACT:
        return y.astype(object).T @ y.astype(object)
    step = max(1, EXACT // max(most * most, 1))
    for a in range(0, len(y), step):
        z = y[a : a + step].astype(float)
        out += (z.T @ z).astype(np.int64).astype(object)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for d, x in _by_dim(batches, "x"):
        own = total.setdefault(d, [0, np.zeros(d, dtype=object)])
        own[0] += len(x)
        own[1] += x.astype(object).sum(axis=0) if np.abs(x).max() > _LONG // len(x) else x.sum(axis=0).astype(object)
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * (d + 1), pa.int32()), "k": pa.array(range(-1, d), pa.int32()), "value": [str(n), *map(str, s)]})


def _products(near: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x in _by_dim(batches, "x"):
            p = _exact_products(x - near[d])
            total[d] = total[d] + p if d in total else p
        for d, p in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * len(i), pa.int32()), "k": pa.array(i * d + j, pa.int32()), "value": [str(v) for v in p[i, j]]})

    return run


def _added(parts: DataFrame) -> list:
    """Exact sums of the tasks' numbers: some dim x dim rows."""
    return parts.groupBy("dim", "k").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()


def distinct_vectors(numbers: DataFrame) -> DataFrame:
    """(dim, x), each vector once. Rows are dealt by hash and compared in full; copies within a task go first."""
    return numbers.groupBy("dim", F.xxhash64("x").alias("h"), "x").agg(F.count(F.lit(1)).alias("n_rows")).select("dim", "x")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each vector length of (dim, x) rows, which should be written already."""
    n, sums = {}, {}
    for r in _added(distinct.mapInArrow(_sums, "dim int, k int, value string")):
        if r["k"] < 0:
            n[r["dim"]] = int(r["value"])
        else:
            sums.setdefault(r["dim"], {})[r["k"]] = int(r["value"])
    near = {d: np.array([round(Fraction(s[k], n[d])) for k in range(d)], dtype=np.int64) for d, s in sums.items()}
    products: dict[int, dict[int, int]] = {}
    for r in _added(distinct.mapInArrow(_products(near), "dim int, k int, value string")) if n else []:
        products.setdefault(r["dim"], {})[r["k"]] = int(r["value"])
    out = {}
    for d in n:
        rest = [sums[d][k] - n[d] * int(near[d][k]) for k in range(d)]
        v = np.zeros((d, d))
        for k, p in products[d].items():
            i, j = divmod(k, d)
            v[i, j] = v[j, i] = float(Fraction(n[d] * p - rest[i] * rest[j], n[d] ** 2))
        e, q = components_of(v)
        out[d] = Whitening(n[d], [sums[d][k] for k in range(d)], e[:components], q[:, :components], float(np.trace(v)))
    return out


def identity_errors(distinct: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of |covariance of the whitened fit list - identity| for each length, measured over the list."""

    reals = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for d, x in _by_dim(batches, "x"):
            w = fits[d].project(x)[:, fits[d].usable]
            own = total.setdefault(d, [0, np.zeros(w.shape[1]), np.zeros((w.shape[1],) * 2)])
            n, mean = len(w), w.mean(axis=0)
            centred, moved = w - mean, mean - own[1]
            own[2] += centred.T @ centred + np.outer(moved, moved) * own[0] * n / (own[0] + n)
            own[1] += moved * n / (own[0] + n)
            own[0] += n
        for d, (n, mean, spread) in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "n": [n], "mean": pa.array([mean.tolist()], reals), "spread": pa.array([spread.ravel().tolist()], reals)})

    parts = distinct.mapInArrow(run, "dim int, n long, mean array<double>, spread array<double>")
    # tasks have centred on their own means, which the sums put right: dim x components^2 rows come to the driver
    cells = parts.select("dim", "n", "mean", F.size("mean").alias("k"), F.posexplode("spread").alias("c", "s"))
    cells = cells.select("dim", "n", "k", "c", "s", F.get("mean", F.floor(F.col("c") / F.col("k")).cast("int")).alias("a"), F.get("mean", F.col("c") % F.col("k")).alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    sums = cells.groupBy("dim", "k", "c").agg(F.sum("n").alias("n"), F.sum(F.col("s") + n * a * b).alias("s"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"))
    out = dict.fromkeys(fits, 0.0)
    for r in sums.collect():
        covariance = r["s"] / r["n"] - r["a"] / r["n"] * r["b"] / r["n"]
        out[r["dim"]] = max(out[r["dim"]], abs(covariance - (r["c"] // r["k"] == r["c"] % r["k"])))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable input row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. Vectors of each length are a space
    of their own with a fit of their own; a shorter vector than ``components`` has as many components as entries. A
    component without variance (one distinct vector, or fewer than dimensions) has a null ``whitened``, and is left out
    of ``identity_error``. Repeated rows give repeated rows and count once in the fit; null ids are kept; an empty table
    gives an empty result; further columns are ignored. A deviation or entry that a long cannot hold is an error.
    """
    numbers = cut(whole_numbers(vectors, scale, id_col, vector_col))
    distinct = cut(distinct_vectors(numbers))
    fits = fit(distinct, components)
    errors = identity_errors(distinct, fits) if fits else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                own = b.take(pa.array(rows))
                f, ids = fits[d], own.column(0)
                x = own.column(2).flatten().to_numpy().reshape(len(rows), d)
                w = f.project(x)
                k = w.shape[1]
                out = {
                    "vec_id": ids.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                    "n": pa.array(np.full(len(rows) * k, f.n)),
                    "deviation": pa.array(np.repeat(_deviation(x, f), k)),
                    "whitened": pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    "explained": pa.array(np.tile(np.maximum(f.values, 0) / f.trace if f.trace else np.zeros(k), len(rows))),
                    "identity_error": pa.array(np.full(len(rows) * k, errors[d])),
                }
                yield pa.RecordBatch.from_pydict(out)

    return numbers.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _deviation(x: np.ndarray, f: Whitening) -> np.ndarray:
    """Sum of (n x - S)^2 of each row, exactly."""
    most = f.n * int(np.abs(x).max(initial=0)) + max(map(abs, f.sums), default=0)
    if most * most * x.shape[1] <= _LONG:
        y = f.n * x - np.array(f.sums, dtype=np.int64)
        return (y * y).sum(axis=1)
    y = f.n * x.astype(object) - np.array(f.sums, dtype=object)
    out = (y * y).sum(axis=1)
    if max(out) > _LONG:
        raise OverflowError("a deviation does not fit a long")
    return out.astype(np.int64)
