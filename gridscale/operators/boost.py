"""Gradient boosting on quantile bins by second-order statistics.

Features become bin numbers once, at quantiles of their own, and the binned table is written. A tree grows by passes over
it: each pass sends the rows down the tree as it stands and sums gradients, hessians and rows by (node, feature, bin), one
aggregation whose result, bounded by nodes x features x bins, is all that reaches the driver. Of two new children only
the smaller one is summed; the other is what is left of their parent. Trees grow leaf by leaf from a queue of gains, level
by level, or symmetrically (one split for a whole level). Rows may be sampled by a hash, or by their gradients (all of the
largest, some of the rest), and earlier trees may be dropped while a new one is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Written
from .trees import Tree

#: Buckets of |gradient| between a number and its double.
STEPS = 32


@dataclass
class Params:
    """``grow`` is leafwise, depthwise or symmetric; ``sample`` is rows (a share of them), goss or none; ``drop`` makes it dart."""

    rounds: int = 12
    rate: float = 0.2
    grow: str = "depthwise"
    leaves: int = 31
    depth: int = 5
    bins: int = 64
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    least_rows: int = 1
    most_step: float = 0.0
    columns: float = 1.0
    sample: str = "none"
    rows: float = 1.0
    top: float = 0.2
    other: float = 0.1
    drop: float = 0.0
    most_drop: int = 50
    skip_drop: float = 0.5
    seed: int = 42
    #: Trees after which rows get their sum so far written.
    refresh: int = 25


@dataclass
class Node:
    depth: int
    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None
    accepted: bool = False


@dataclass
class Growing:
    """A tree whose nodes know their histograms, (features, bins, 3): gradients, hessians, rows."""

    nodes: list[Node] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs = [n.children or (-1, -1) for n in self.nodes]
        return np.array([n.feature for n in self.nodes]), np.array([n.bin for n in self.nodes]), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The deepest node of each row of bin numbers."""
    feature, cut, left, right = tree
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        inner = left[at] >= 0
        if not inner.any():
            return at
        low = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(inner, np.where(low, left[at], right[at]), at)


def leaf_value(g, h, p: Params):
    """The step of a leaf: the soft-thresholded gradient over the hessian."""
    w = -np.sign(g) * np.maximum(np.abs(g) - p.l1, 0) / (h + p.l2 + 1e-300)
    return np.clip(w, -p.most_step, p.most_step) if p.most_step else w


def split_gains(sums: np.ndarray, p: Params) -> np.ndarray:
    """Gain of the split after each bin of each feature, (features, bins); -inf where a side is too small."""
    score = lambda s: np.maximum(np.abs(s[..., 0]) - p.l1, 0) ** 2 / (s[..., 1] + p.l2 + 1e-300)
    low = np.cumsum(sums, axis=1)
    whole = low[:, -1:, :]
    high = whole - low
    gain = 0.5 * (score(low) + score(high) - score(whole)) - p.least_gain
    fits = (low[..., 1] >= p.least_weight) & (high[..., 1] >= p.least_weight) & (low[..., 2] >= p.least_rows) & (high[..., 2] >= p.least_rows)
    return np.where(fits, gain, -np.inf)


def best_split(gains: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the largest gain; of gains equal to ten digits that of the first feature and bin."""
    top = gains.max()
    if not np.isfinite(top) or top <= 1e-12:
        return 0.0, -1, -1
    k = int(np.flatnonzero(gains.ravel() >= top - 1e-10 * abs(top))[0])
    return float(gains.ravel()[k]), *map(int, divmod(k, gains.shape[1]))


def _uniform(row: np.ndarray, *salt: int) -> np.ndarray:
    """A repeatable number from 0 to 1 for each row number."""
    x = row.astype(np.uint64) + np.uint64(sum((s + 1) * 0x9E3779B97F4A7C15 << k for k, s in enumerate(salt)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def quantile_edges(table: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Rising edges of each feature, at most ``bins`` - 1: a value's bin is the number of edges at or below it."""
    shares = [k / bins for k in range(1, bins)]
    got = table.agg(*[F.percentile_approx(f, shares, 10_000).alias(str(k)) for k, f in enumerate(features)], *[F.min(f).alias(f"low{k}") for k, f in enumerate(features)]).first()
    return [np.array(sorted({float(v) for v in got[str(k)] or []} - {None if got[f"low{k}"] is None else float(got[f"low{k}"])})) for k in range(len(features))]


def binned(table: DataFrame, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(row, bins, y, f): a byte for each feature; ``row`` is fixed once the table is written, f is the sum so far."""
    schema = pa.schema([("row", pa.int64()), ("bins", pa.binary()), ("y", pa.float64()), ("f", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.column_stack([np.searchsorted(e, b.column(2 + k).to_numpy(zero_copy_only=False), side="right").astype(np.uint8) for k, e in enumerate(edges)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), pa.array(np.zeros(len(b)))], schema=schema)

    own = table.select(F.monotonically_increasing_id().alias("_row"), F.col("y").cast("double"), *[F.col(c).cast("double") for c in features])
    return own.mapInArrow(run, "row long, bins binary, y double, f double")


def _matrix(b: pa.RecordBatch, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, n)


class Boosting:
    """The fit of one model: the written table, the trees so far and how a round sees the rows."""

    def __init__(self, table: DataFrame, features: list[str], p: Params, edges: list[np.ndarray] | None = None):
        self.p, self.features = p, features
        self.edges = edges or quantile_edges(table, features, min(p.bins, 256))
        self.written = Written(binned(table, features, self.edges))
        ends = self.written.table.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
        if not ends["n"]:
            raise ValueError("no complete rows to fit")
        self.base, self.n_rows = float(ends["m"]), ends["n"]
        self.trees: list[tuple] = []  # arrays, values
        self.scales: list[float] = []
        self.fresh = 0  # trees that the column f holds already
        self.passes = 0

    def _gradients(self, left_out: tuple[int, ...] = ()):
        """A function of a batch: its bins, row numbers, and gradients against the trees that are not left out."""
        n, base = len(self.features), self.base
        some = [(t, v * s) for k, ((t, v), s) in enumerate(zip(self.trees, self.scales, strict=True)) if k >= self.fresh and k not in left_out]

        def of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = _matrix(b, n)
            f = b.column(3).to_numpy() + base
            for t, v in some:
                f = f + v[walk(t, x)]
            return x, b.column(0).to_numpy(), f - b.column(2).to_numpy()

        return of

    def _sampling(self, k: int, gradients) -> tuple:
        """How round ``k`` weighs rows: (kind, share or limit, share and weight of the rest)."""
        p = self.p
        if p.sample == "rows" and p.rows < 1:
            return "rows", p.rows, 0.0, 0.0
        if p.sample != "goss":
            return "all", 0.0, 0.0, 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[int, int] = {}
            for b in batches:
                if len(b):
                    g = np.abs(gradients(b)[2])
                    for v, c in zip(*np.unique(np.floor(STEPS * np.log2(np.maximum(g, 1e-300))).astype(np.int64), return_counts=True), strict=True):
                        counts[int(v)] = counts.get(int(v), 0) + int(c)
            yield pa.RecordBatch.from_pydict({"v": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

        told = sorted(((r["v"], r["n"]) for r in self.written.table.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()), reverse=True)
        so_far, limit = 0, 0.0
        for v, n in told:  # some thousand buckets at most
            so_far, limit = so_far + n, 2.0 ** (v / STEPS)
            if so_far >= p.top * self.n_rows:
                break
        rest = 1 - so_far / self.n_rows
        share = min(1.0, p.other / rest) if rest > 0 else 0.0
        return "goss", limit, share, 1 / share if share else 0.0

    def sums(self, gradients, tree: tuple, wanted: list[int], sampling: tuple, columns: np.ndarray, salt: int) -> dict[int, np.ndarray]:
        """Histograms of the nodes ``wanted``: one aggregation by (node, feature, bin)."""
        n_bins, seed = max(len(e) for e in self.edges) + 1, self.p.seed
        kind, limit, share, weight = sampling
        place = np.full(len(tree[0]), -1)
        place[wanted] = np.arange(len(wanted))
        size = len(columns) * n_bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(wanted) * size))
            for b in batches:
                if not len(b):
                    continue
                x, row, g = gradients(b)
                node = place[walk(tree, x)]
                w = np.ones(len(g))
                if kind == "rows":
                    w = (_uniform(row, seed, salt) < limit).astype(float)
                elif kind == "goss":
                    w = np.where(np.abs(g) >= limit, 1.0, np.where(_uniform(row, seed, salt) < share, weight, 0.0))
                on = (node >= 0) & (w > 0)
                cell = (node[on, None] * len(columns) + np.arange(len(columns))) * n_bins + x[on][:, columns]
                for k, v in enumerate((g * w, w, (w > 0).astype(float))):
                    total[k] += np.bincount(cell.ravel(), weights=np.repeat(v[on], len(columns)), minlength=total.shape[1])
            cells = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array(cells // size, pa.int32()), "feature": pa.array(cells % size // n_bins, pa.int32()), "bin": pa.array(cells % n_bins, pa.int32()), "g": total[0, cells], "h": total[1, cells], "n": total[2, cells].astype(np.int64)}
            )

        parts = self.written.table.mapInArrow(run, "node int, feature int, bin int, g double, h double, n long")
        got = parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
        self.passes += 1
        out = np.zeros((len(wanted), len(columns), n_bins, 3))
        at = got["node"].to_numpy(), got["feature"].to_numpy(), got["bin"].to_numpy()
        for k, c in enumerate("ghn"):
            out[(*at, k)] = got[c].to_numpy()
        return dict(zip(wanted, out, strict=True))

    def _judge(self, node: Node) -> None:
        if node.depth < self.p.depth or self.p.depth <= 0:
            node.gain, node.feature, node.bin = best_split(split_gains(node.sums, self.p))

    def grow(self, k: int, gradients) -> Growing:
        """A tree on the gradients of round ``k``, in places of the columns that the round sees."""
        p, rng = self.p, np.random.default_rng([self.p.seed, k])
        n = len(self.features)
        self.columns = np.sort(rng.permutation(n)[: max(1, round(p.columns * n))])
        sampling = self._sampling(k, gradients)
        every = lambda tree, wanted: self.sums(gradients, tree, wanted, sampling, self.columns, k)
        t = Growing([Node(0, every((np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1])), [0])[0])])
        self._judge(t.nodes[0])
        leaves = [0]
        most = p.leaves if p.grow == "leafwise" else 1 << 30
        while True:
            if p.grow == "symmetric":
                self._level(t, leaves)
            able = sorted((i for i in leaves if t.nodes[i].feature >= 0), key=lambda i: (-t.nodes[i].gain, i))[: most - len(leaves)]
            if not able:
                break
            ask = [i for i in able if t.nodes[i].children is None]
            if ask:
                self._open(t, ask, every)
            if p.grow != "leafwise":
                for i in able:
                    leaves.remove(i)
                    leaves += t.nodes[i].children
                    t.nodes[i].accepted = True
                continue
            while len(leaves) < most:  # as far as the children of the best leaf are known
                able = [i for i in leaves if t.nodes[i].feature >= 0]
                i = min(able, key=lambda i: (-t.nodes[i].gain, i), default=None)
                if i is None or t.nodes[i].children is None:
                    break
                leaves.remove(i)
                leaves += t.nodes[i].children
                t.nodes[i].accepted = True
            if len(leaves) >= most:
                break
        return t

    def _open(self, t: Growing, ask: list[int], every) -> None:
        """Children of the nodes ``ask``, with their histograms, from one pass that sums the smaller ones."""
        # column places become features for the pass and back
        small = []
        for i in ask:
            node = t.nodes[i]
            low = node.sums[node.feature, : node.bin + 1].sum(axis=0)
            node.children = (len(t.nodes), len(t.nodes) + 1)
            t.nodes += [Node(node.depth + 1, low), Node(node.depth + 1, low)]
            small.append(node.children[0] if 2 * low[2] <= node.sums[node.feature, :, 2].sum() else node.children[1])
        feature, cut, left, right = t.arrays()
        found = every((np.where(feature >= 0, self.columns[feature], -1), cut, left, right), small)
        for i, s in zip(ask, small, strict=True):
            a, b = t.nodes[i].children
            t.nodes[s].sums = found[s]
            rest = t.nodes[i].sums - found[s]
            t.nodes[a + b - s].sums = np.where(rest[..., 2:] > 0.5, rest, 0.0)
            self._judge(t.nodes[a])
            self._judge(t.nodes[b])

    def _level(self, t: Growing, leaves: list[int]) -> None:
        """One split for all leaves: that of the largest sum of gains."""
        open_leaves = [i for i in leaves if t.nodes[i].depth < self.p.depth]
        gains = [np.maximum(np.where(np.isfinite(g := split_gains(t.nodes[i].sums, self.p)), g, 0.0), 0.0) for i in open_leaves]
        _, f, b = best_split(sum(gains)) if gains else (0.0, -1, -1)
        for i in leaves:
            n = t.nodes[i]
            sides = n.sums[f, : b + 1, 2].sum(), n.sums[f, b + 1 :, 2].sum()
            n.feature, n.bin = (f, b) if f >= 0 and i in open_leaves and min(sides) > 0 else (-1, -1)
            n.depth += n.feature < 0  # the level passes a leaf by that it doesn't part

    def finished(self, t: Growing) -> tuple[tuple, np.ndarray, Tree]:
        """The accepted part of a tree: its arrays over bins, its values, and the tree over real thresholds."""
        keep, number = [0], {0: 0}
        for i in keep:
            if t.nodes[i].accepted:
                for c in t.nodes[i].children:
                    number[c] = len(keep)
                    keep.append(c)
        nodes = [t.nodes[i] for i in keep]
        inner = np.array([n.accepted for n in nodes])
        feature = np.array([self.columns[n.feature] if n.accepted else -1 for n in nodes])
        cut = np.array([n.bin if n.accepted else -1 for n in nodes])
        left = np.array([number[n.children[0]] if n.accepted else -1 for n in nodes])
        right = np.array([number[n.children[1]] if n.accepted else -1 for n in nodes])
        whole = np.array([n.sums[0].sum(axis=0) for n in nodes])
        value = np.where(inner, 0.0, self.p.rate * leaf_value(whole[:, 0], whole[:, 1], self.p))
        threshold = np.array([self.edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut, strict=True)])
        return (feature, cut, left, right), value, Tree(feature, threshold, left, right, value, whole[:, 2])

    def run(self) -> BoostModel:
        p, real = self.p, []
        for k in range(p.rounds):
            rng = np.random.default_rng([p.seed, k, 7])
            out: tuple[int, ...] = ()
            if p.drop and self.trees and rng.random() >= p.skip_drop:
                out = tuple(np.flatnonzero(rng.random(len(self.trees)) < p.drop)[: p.most_drop].tolist())
            t = self.grow(k, self._gradients(out))
            arrays, value, tree = self.finished(t)
            share = 1 / (len(out) + 1)
            for i in out:
                self.scales[i] *= len(out) * share
            self.trees.append((arrays, value))
            self.scales.append(share)
            real.append(tree)
            if not p.drop and len(self.trees) - self.fresh >= p.refresh and k + 1 < p.rounds:
                self._refresh()
        self.written.drop()
        return BoostModel(self.features, self.base, real, self.scales)

    def _refresh(self) -> None:
        """Writes the rows' sums so far, so that passes need the newer trees only."""
        gradients, base = self._gradients(), self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    f = gradients(b)[2] + b.column(2).to_numpy() - base
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(f)], ["row", "bins", "y", "f"])

        new = Written(self.written.table.mapInArrow(run, "row long, bins binary, y double, f double"))
        self.written.drop()
        self.written, self.fresh = new, len(self.trees)


class BoostModel:
    def __init__(self, features: list[str], base: float, trees: list[Tree], scales: list[float]):
        self.features, self.base, self.trees, self.scales = features, base, trees, scales

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((s * t.predict(x) for t, s in zip(self.trees, self.scales, strict=True)), np.zeros(len(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with all features, and their ``prediction``."""
        predict = self.predict

        @F.pandas_udf("double")
        def told(x: pd.DataFrame) -> pd.Series:
            return pd.Series(predict(x.to_numpy(dtype=float)))

        return df.dropna(subset=self.features).withColumn("prediction", told(F.struct(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(self.features)])))

    def save(self, spark: SparkSession, path: str) -> None:
        """Features, base and scales in one row; a row for each node."""
        spark.createDataFrame([(self.features, self.base, self.scales)], "features array<string>, base double, scales array<double>").write.mode("overwrite").parquet(f"{path}/model")
        rows = [(k, i, int(t.feature[i]), float(t.threshold[i]), int(t.left[i]), int(t.right[i]), float(t.value[i]), float(t.cover[i])) for k, t in enumerate(self.trees) for i in range(len(t.left))]
        spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double, cover double").write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostModel:
        told = spark.read.parquet(f"{path}/model").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        trees = [Tree(*[x[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "cover")]) for _, x in nodes.groupby("tree")]
        return BoostModel(list(told["features"]), told["base"], trees, list(told["scales"]))


#: Families: levels with both penalties and sampled rows, leaves with gradient sampling, symmetric levels.
FAMILIES = {
    "xgb": {"grow": "depthwise", "depth": 5, "l2": 1.0, "sample": "rows", "rows": 0.8, "rate": 0.25},
    "lgb": {"grow": "leafwise", "leaves": 15, "depth": 0, "l2": 0.0, "least_weight": 1e-3, "least_rows": 20, "sample": "goss", "rate": 0.25},
    "catb": {"grow": "symmetric", "depth": 5, "l2": 3.0, "rate": 0.25},
}


class Booster:
    """An estimator: ``fit`` a table with the features and ``y``; rows with a missing one are left out."""

    def __init__(self, features: list[str], family: str = "xgb", **params):
        known = {f.name for f in fields(Params)}
        if bad := set(params) - known:
            raise ValueError(f"no parameters named {sorted(bad)}")
        self.features, self.params = features, Params(**{**FAMILIES[family], **params})

    def fit(self, table: DataFrame) -> BoostModel:
        return Boosting(table.dropna(subset=[*self.features, "y"]), self.features, self.params).run()
