"""Regressors that Spark ML lacks, fitted by distributed gradients: a network, and an epsilon-insensitive fit, linear or
with a Gaussian kernel by random Fourier features.

Rows are dealt to mini-batches by a hash and written once, a folder for each batch, so a step reads its batch only. Tasks
return one vector, the gradient summed over their rows; vectors are added in groups before the driver adds the rest. A
share of the rows is held back, and the weights with the least loss on it are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Written

#: Rows of a mini-batch, and buckets of rows that hold back the last for early stopping.
BATCH_ROWS, HELD = 200_000, 10
#: Vectors that one task adds.
ADDED = 32


def _summed(data: DataFrame, n_features: int, part, n: int) -> tuple[np.ndarray, float, int]:
    """Sum over all rows of the gradient and loss that ``part(x, y)`` gives for a batch of rows (x, y)."""
    schema = pa.schema([("k", pa.int64()), ("g", pa.binary()), ("loss", pa.float64()), ("rows", pa.int64())])

    def row(k: int, g: np.ndarray, loss: float, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"k": [k], "g": [g.tobytes()], "loss": [loss], "rows": [rows]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g, loss, rows = np.zeros(n), 0.0, 0
        for b in batches:
            if len(b):
                x = np.column_stack([b.column(k).to_numpy() for k in range(n_features)])
                d, value = part(x, b.column(n_features).to_numpy())
                g, loss, rows = g + d, loss + value, rows + len(b)
        if rows:
            yield row(TaskContext.get().partitionId() // ADDED, g, loss, rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for k, g, loss, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = total.setdefault(k, [np.zeros(n), 0.0, 0])
                own[0] += np.frombuffer(g)
                own[1] += loss
                own[2] += rows
        for k, v in total.items():
            yield row(k, *v)

    parts = data.mapInArrow(run, "k long, g binary, loss double, rows long")
    if data.rdd.getNumPartitions() > ADDED:
        parts = parts.repartition("k").mapInArrow(add, "k long, g binary, loss double, rows long")
    g, loss, rows = np.zeros(n), 0.0, 0
    for r in parts.collect():  # a vector for each ADDED tasks
        g, loss, rows = g + np.frombuffer(r["g"]), loss + r["loss"], rows + r["rows"]
    return g, loss, rows


class Scaled:
    """Medians and quartile ranges of the features, and mean and deviation of the target."""

    def __init__(self, centre: np.ndarray, width: np.ndarray, mean: float, spread: float):
        self.centre, self.width, self.mean, self.spread = centre, width, mean, spread

    @staticmethod
    def of(data: DataFrame, features: list[str]) -> Scaled:
        q = data.agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 10000).alias(f"q{k}") for k, f in enumerate(features)], F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s")).first()
        if q["_m"] is None:
            raise ValueError("no complete rows to fit")
        at = [q[f"q{k}"] for k in range(len(features))]
        return Scaled(np.array([v[1] for v in at], dtype=float), np.array([(v[2] - v[0]) or 1.0 for v in at], dtype=float), float(q["_m"]), float(q["_s"]) or 1.0)

    def x(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.width


class Network:
    """Fully connected layers with rectified units and one output. No hidden layer and ``epsilon`` make it a linear
    epsilon-insensitive regressor with a penalty on its weights; ``fourier`` such features first make that one of a
    Gaussian kernel exp(-gamma |x - z|^2) over scaled features, with an error of some 1 / sqrt(fourier)."""

    def __init__(self, features: list[str], hidden: tuple[int, ...] = (16, 8), epsilon: float | None = None, fourier: int = 0, gamma: float | None = None, penalty: float = 0.0, seed: int = 42):
        self.features, self.hidden, self.epsilon, self.fourier, self.penalty, self.seed = list(features), tuple(hidden), epsilon, fourier, penalty, seed
        self.gamma = gamma or 1.0 / max(len(features), 1)
        rng = np.random.default_rng(seed)
        self.frequencies = rng.normal(0, np.sqrt(2 * self.gamma), (len(features), fourier))
        self.phases = rng.uniform(0, 2 * np.pi, fourier)
        self.shapes = list(zip([fourier or len(features), *hidden], [*hidden, 1], strict=True))
        self.weights = np.concatenate([np.r_[rng.normal(0, np.sqrt(2 / a), a * b) * (epsilon is None), np.zeros(b)] for a, b in self.shapes])
        self.scale: Scaled | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Scaled features, or their random Fourier features, whose inner products are those of the kernel."""
        return np.sqrt(2 / self.fourier) * np.cos(x @ self.frequencies + self.phases) if self.fourier else x

    def _layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        values, layers = [self.lifted(x)], self._layers(w)
        for k, (m, bias) in enumerate(layers):
            z = values[-1] @ m + bias
            values.append(z if k == len(layers) - 1 else np.maximum(z, 0))
        return values

    def _gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        total, loss, layers = np.zeros(len(w)), 0.0, self._layers(w)
        for a in range(0, len(x), 4096):  # activations of some thousand rows at a time
            values = self._forward(w, x[a : a + 4096])
            error = values[-1][:, 0] - y[a : a + 4096]
            if self.epsilon is None:
                d = error
                loss += float((error**2).sum() / 2)
            else:
                over = np.maximum(np.abs(error) - self.epsilon, 0)
                d = np.sign(error) * (over > 0)
                loss += float(over.sum())
            d, parts = d[:, None], []
            for k in range(len(self.shapes) - 1, -1, -1):
                parts.append(np.r_[(values[k].T @ d).ravel(), d.sum(axis=0)])
                if k:
                    d = (d @ layers[k][0].T) * (values[k] > 0)
            total += np.concatenate(parts[::-1])
        return total, loss

    def fit(self, data: DataFrame, rounds: int = 60, rate: float = 0.03, patience: int = 10, batch_rows: int = BATCH_ROWS) -> Network:
        """At most ``rounds`` passes over the rows, fewer if ``patience`` of them bring nothing on the rows held back."""
        own = data.dropna(subset=[*self.features, "y"])
        self.scale = scale = Scaled.of(own, self.features)
        n = len(self.features)
        table = own.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(self.features)], F.col("y").cast("double").alias("y"))
        h = F.xxhash64(*table.columns)
        n_batches = max(1, round(own.count() / batch_rows))
        batch = F.when(F.pmod(h, F.lit(HELD)) == HELD - 1, -1).otherwise(F.pmod(F.floor(h / HELD), F.lit(n_batches))).cast("int")
        written = Written(table.withColumn("batch", batch), by=["batch"])
        part = lambda w: lambda x, y: self._gradient(w, scale.x(x), (y - scale.mean) / scale.spread)
        one = lambda b: written.table.where(F.col("batch") == b).select(*table.columns)
        m, v, step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        best, best_loss, waited, w = self.weights, np.inf, 0, self.weights
        for k in range(rounds):
            for b in np.random.default_rng([self.seed, k]).permutation(n_batches).tolist():
                g, _, rows = _summed(one(b), n, part(w), len(w))
                g, step = g / max(rows, 1) + self.penalty * w, step + 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w = w - rate * (1 - k / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            _, loss, rows = _summed(one(-1), n, part(w), len(w))
            loss = loss / rows if rows else -k
            best, best_loss, waited = (w, loss, 0) if loss < best_loss else (best, best_loss, waited + 1)
            if waited >= patience:
                break
        written.drop()
        self.weights = best
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(self.weights, self.scale.x(x[a : a + 4096]))[-1][:, 0] for a in range(0, len(x), 4096)] or [np.zeros(0)]) * self.scale.spread + self.scale.mean

    def transform(self, data: DataFrame) -> DataFrame:
        """Rows with all features, and their ``prediction``."""
        predict = self.predict

        @F.pandas_udf("double")
        def told(x: pd.DataFrame) -> pd.Series:
            return pd.Series(predict(x.to_numpy(dtype=float)))

        return data.dropna(subset=self.features).withColumn("prediction", told(F.struct(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(self.features)])))

    def save(self, spark: SparkSession, path: str) -> None:
        """Settings, scales and weights in one row; random features come from the seed."""
        s = self.scale
        row = (self.features, list(self.hidden), self.epsilon, self.fourier, self.gamma, self.penalty, self.seed, s.centre.tolist(), s.width.tolist(), s.mean, s.spread, self.weights.tolist())
        schema = "features array<string>, hidden array<int>, epsilon double, fourier int, gamma double, penalty double, seed long, centre array<double>, width array<double>, mean double, spread double, weights array<double>"
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Network:
        r = spark.read.parquet(path).first()
        out = Network(r["features"], tuple(r["hidden"]), r["epsilon"], r["fourier"], r["gamma"], r["penalty"], r["seed"])
        out.scale, out.weights = Scaled(np.array(r["centre"]), np.array(r["width"]), r["mean"], r["spread"]), np.array(r["weights"])
        return out


def svr(features: list[str], epsilon: float = 0.1, fourier: int = 0, gamma: float | None = None, penalty: float = 0.0) -> Network:
    return Network(features, (), epsilon, fourier, gamma, penalty)
