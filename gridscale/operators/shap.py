"""Exact attributions of tree ensembles, path by path.

A leaf's path is kept as arrays: for each distinct feature on it, the interval of values that stays on the path and the
share of training rows that do (the product of cover ratios of its splits). With a set of features known, a tree's
expectation is the sum over leaves of the value, times 1 or 0 for each known feature that stays or not, times the share of
each unknown one. A feature's Shapley value, and a pair's interaction, come in closed form from the polynomial in whose
product every feature of the path has one factor; samples are worked in batches against all leaves of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Tree, trees_of

#: Samples that are worked at a time.
ROWS = 256


@dataclass
class Paths:
    """Leaves of one tree by number of distinct features on their paths: features, (leaves, m); intervals and shares of
    the same shape; values of the leaves."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    closed: bool

    def stays(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves, m): whether a sample's feature keeps to the path."""
        v = x[:, self.feature]
        return (v > self.low) & (v <= self.high) if self.closed else (v >= self.low) & (v < self.high)


def paths_of(tree: Tree) -> list[Paths]:
    """The leaves' paths, those with equally many features together."""
    groups: dict[int, list] = {}

    def down(k: int, known: dict[int, tuple[float, float, float]]) -> None:
        if tree.left[k] < 0:
            groups.setdefault(len(known), []).append((list(known), list(known.values()), tree.value[k]))
            return
        f, t = int(tree.feature[k]), tree.threshold[k]
        low, high, share = known.get(f, (-np.inf, np.inf, 1.0))
        for child, interval in ((tree.left[k], (low, min(high, t))), (tree.right[k], (max(low, t), high))):
            part = tree.cover[child] / tree.cover[k] if tree.cover[k] else 0.0
            down(child, {**known, f: (*interval, share * part)})

    down(0, {})
    out = []
    for m, rows in sorted(groups.items()):
        spans = np.array([r[1] for r in rows], dtype=float).reshape(len(rows), m, 3)
        out.append(Paths(np.array([r[0] for r in rows], dtype=int).reshape(len(rows), m), spans[..., 0], spans[..., 1], spans[..., 2], np.array([r[2] for r in rows]), tree.closed))
    return out


@lru_cache(maxsize=256)
def _orders(m: int, of: int) -> np.ndarray:
    """Weight of a known set of size k among the ``m`` other features of a path: k! (m - k)! / (m + 1)!, half that for a pair."""
    return np.array([factorial(k) * factorial(m - k) / factorial(m + 1) for k in range(m + 1)]) / (2 if of == 2 else 1)


def _poly(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Coefficients in t of the product of (z_j + o_j t) over the last axis: t counts known features."""
    m = z.shape[-1]
    out = np.zeros(np.broadcast_shapes(z.shape, o.shape)[:-1] + (m + 1,))
    out[..., 0] = 1
    for j in range(m):
        out[..., 1 : j + 2] = out[..., 1 : j + 2] * z[..., j, None] + out[..., : j + 1] * o[..., j, None]
        out[..., 0] *= z[..., j]
    return out


def attributions(trees: list[Tree], weights: list[float], base: float, x: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Shapley values (rows, n) of the samples, and the expected prediction that they start from."""
    phi, start = np.zeros((len(x), n)), base
    for tree, w in zip(trees, weights, strict=True):
        for p in paths_of(tree):
            start += w * float((p.value * p.share.prod(axis=1)).sum())
            m = p.feature.shape[1]
            if not m:
                continue
            for a in range(0, len(x), ROWS):
                o = p.stays(x[a : a + ROWS]).astype(float)
                z = np.broadcast_to(p.share, o.shape)
                for j in range(m):
                    others = [k for k in range(m) if k != j]
                    c = _poly(z[..., others], o[..., others]) @ _orders(m - 1, 1)
                    part = w * p.value * c * (o[..., j] - z[..., j])
                    np.add.at(phi, (slice(a, a + len(o)), p.feature[:, j]), part)
    return phi, start


def pair_interactions(trees: list[Tree], weights: list[float], x: np.ndarray, n: int) -> np.ndarray:
    """Shapley interaction values (rows, n, n): pairs share theirs equally, and each row of the matrix sums to the
    feature's attribution."""
    out = np.zeros((len(x), n, n))
    for tree, w in zip(trees, weights, strict=True):
        for p in paths_of(tree):
            m = p.feature.shape[1]
            for a in range(0, len(x), ROWS):
                o = p.stays(x[a : a + ROWS]).astype(float)
                z = np.broadcast_to(p.share, o.shape)
                rows = slice(a, a + len(o))
                for i in range(m):
                    for j in range(i + 1, m):
                        others = [k for k in range(m) if k not in (i, j)]
                        c = _poly(z[..., others], o[..., others]) @ _orders(m - 2, 2)
                        part = w * p.value * c * (o[..., i] - z[..., i]) * (o[..., j] - z[..., j])
                        np.add.at(out, (rows, p.feature[:, i], p.feature[:, j]), part)
                        np.add.at(out, (rows, p.feature[:, j], p.feature[:, i]), part)
    phi, _ = attributions(trees, weights, 0.0, x, n)
    k = np.arange(n)
    out[:, k, k] = 0.0
    out[:, k, k] = phi - out.sum(axis=2)
    return out


def tree_attributions(model, samples: DataFrame, features: list[str], id_col: str = "sample_id") -> tuple[DataFrame, float]:
    """(sample_id, feature, x, phi) of every sample with all features, and the base that attributions add up from: with
    it they sum to the prediction. The model is a forest, a booster or a pipeline of one; its trees travel with the tasks."""
    trees, weights, base = trees_of(model)
    n = len(features)
    _, start = attributions(trees, weights, base, np.zeros((0, n)), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.column_stack([b.column(1 + k).to_numpy() for k in range(n)])
                phi, _ = attributions(trees, weights, base, x, n)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(features * len(b)), pa.array(x.ravel()), pa.array(phi.ravel())], ["sample_id", "feature", "x", "phi"])

    own = samples.dropna(subset=features).select(F.col(id_col).alias("sample_id"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    return own.mapInArrow(run, f"sample_id {own.schema['sample_id'].dataType.simpleString()}, feature string, x double, phi double"), start


def tree_interactions(model, samples: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, strength): mean absolute interaction value of each pair, both halves together, over all samples."""
    trees, weights, _ = trees_of(model)
    n = len(features)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((n, n)), 0
        for b in batches:
            for a in range(0, len(b), 4 * ROWS):
                x = np.column_stack([b.column(k).to_numpy()[a : a + 4 * ROWS] for k in range(n)])
                total, rows = total + np.abs(pair_interactions(trees, weights, x, n)).sum(axis=0), rows + len(x)
        yield pa.RecordBatch.from_pydict({"a": [features[i] for i, _ in pairs], "b": [features[j] for _, j in pairs], "s": [2 * total[i, j] for i, j in pairs], "n": [rows] * len(pairs)})

    own = samples.dropna(subset=features).select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    parts = own.mapInArrow(run, "a string, b string, s double, n long")
    return parts.groupBy("a", "b").agg((F.sum("s") / F.sum("n")).alias("strength"))
