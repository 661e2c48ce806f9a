"""Regression trees as arrays, whatever fitted them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node k sends a row to ``left[k]`` if its feature's value is below ``threshold[k]`` (at most it, if ``closed``), else
    to ``right[k]``; leaves have left = -1. ``cover`` is the number of training rows in the node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    closed: bool = False

    @property
    def depth(self) -> int:
        level = np.zeros(len(self.left), dtype=int)
        for k in range(len(self.left)):  # parents come before their children
            if self.left[k] >= 0:
                level[[self.left[k], self.right[k]]] = level[k] + 1
        return int(level.max(initial=0))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            v = x[rows, np.maximum(self.feature[at], 0)]
            low = v <= self.threshold[at] if self.closed else v < self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def _spark_tree(model) -> Tree:
    """The arrays of one of Spark's decision trees."""
    feature, threshold, left, right, value, cover = [], [], [], [], [], []

    def add(node) -> int:
        k = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, node.prediction()), (cover, node.impurityStats().count())):
            column.append(v)
        if node.subtreeDepth() > 0:
            feature[k], threshold[k] = node.split().featureIndex(), node.split().threshold()
            left[k] = add(node.leftChild())
            right[k] = add(node.rightChild())
        return k

    add(model._call_java("rootNode"))
    return Tree(np.array(feature), np.array(threshold, dtype=float), np.array(left), np.array(right), np.array(value, dtype=float), np.array(cover, dtype=float), True)


def trees_of(model) -> tuple[list[Tree], list[float], float]:
    """Trees, their weights and a constant whose sum is the model's prediction: of a forest, a booster or a pipeline of one."""
    if hasattr(model, "stages"):
        model = model.stages[-1]
    if hasattr(model, "base") and hasattr(model, "trees"):  # a booster of this library
        return list(model.trees), list(model.scales), float(model.base)
    trees = [_spark_tree(t) for t in getattr(model, "trees", [model])]
    weights = [float(w) for w in getattr(model, "treeWeights", [1.0])]
    if type(model).__name__ == "RandomForestRegressionModel":
        weights = [w / sum(weights) for w in weights]
    return trees, weights, 0.0
