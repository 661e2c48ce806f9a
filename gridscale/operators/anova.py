"""Importance of parameters by functional analysis of variance over the leaf boxes of a forest.

A tree over the search space is a function that is constant on boxes. The mean over all other parameters as one varies, its
marginal, is constant on the segments between that parameter's ends of boxes; its variance as a share of the whole
function's is the parameter's importance, averaged over trees. Shares add up to at most 1; what is missing is interaction.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .trees import Tree

BOXES = "tree int, leaf int, param string, lo double, hi double, value double"


def boxes_of(spark: SparkSession, trees: list[Tree], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(tree, leaf, param, lo, hi, value): the leaves' boxes, each parameter's range as 0 to 1; empty boxes are left out."""
    names, rows = list(bounds), []
    for t, tree in enumerate(trees):
        stack = [(0, {})]
        while stack:
            k, cut = stack.pop()
            if tree.left[k] >= 0:
                f = names[tree.feature[k]]
                lo, hi = cut.get(f, (0.0, 1.0))
                at = min(max((float(tree.threshold[k]) - bounds[f][0]) / (bounds[f][1] - bounds[f][0]), lo), hi)
                stack += [(int(tree.left[k]), {**cut, f: (lo, at)}), (int(tree.right[k]), {**cut, f: (at, hi)})]
            elif all(hi > lo for lo, hi in cut.values()):
                rows += [(t, k, f, *cut.get(f, (0.0, 1.0)), float(tree.value[k])) for f in names]
    return spark.createDataFrame(rows, BOXES)


def marginals(boxes: DataFrame) -> DataFrame:
    """(tree, param, lo, width, mean): the mean of the tree's function on each segment of each parameter."""
    width = F.col("hi") - F.col("lo")
    volume = boxes.groupBy("tree", "leaf").agg(F.product(width).alias("volume"))
    rest = boxes.join(volume, ["tree", "leaf"]).withColumn("weight", F.col("value") * F.col("volume") / width)
    ends = boxes.select("tree", "param", "lo").union(boxes.select("tree", "param", "hi")).distinct()
    step = Window.partitionBy("tree", "param").orderBy("lo")
    segments = ends.withColumn("width", F.lead("lo").over(step) - F.col("lo")).where("width > 0").withColumnRenamed("lo", "at")
    inside = (F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi"))
    return segments.join(rest, ["tree", "param"]).where(inside).groupBy("tree", "param", "at", "width").agg(F.sum("weight").alias("mean")).withColumnRenamed("at", "lo")


def shares(boxes: DataFrame) -> DataFrame:
    """(tree, param, share): variance of each marginal as a share of the tree's; 0 where a tree is constant."""
    width = F.col("hi") - F.col("lo")
    leaves = boxes.groupBy("tree", "leaf").agg(F.product(width).alias("volume"), F.first("value").alias("value"))
    v, w = F.col("value"), F.col("volume")
    whole = leaves.groupBy("tree").agg(F.sum(w * v).alias("m"), F.sum(w * v * v).alias("square")).select("tree", "m", (F.col("square") - F.col("m") * F.col("m")).alias("total"))
    own = marginals(boxes).join(whole, "tree").groupBy("tree", "param", "total").agg(F.sum(F.col("width") * (F.col("mean") - F.col("m")) ** 2).alias("own"))
    return own.select("tree", "param", F.when(F.col("total") > 1e-12, F.col("own") / F.col("total")).otherwise(0.0).alias("share"))


def importance(boxes: DataFrame) -> DataFrame:
    return shares(boxes).groupBy("param").agg(F.avg("share").alias("importance"))


def encoded(trials: DataFrame, space: list[tuple]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Finished trials (y and a number for each parameter) and the parameters' ranges: logarithms where the space is
    logarithmic, the place in the list for choices; trials without a parameter get the middle of its range."""
    columns, bounds = [], {}
    for p in space:
        v = F.col("params")[p[0]]
        if p[1] == "choice":
            lo, hi = 0.0, float(len(p[2]))
            x = F.array_position(F.array(*map(F.lit, p[2])), v) - 0.5
        else:
            lo, hi = (math.log(b) if p[1] == "log" else float(b) for b in p[2:4])
            x = F.log(v.cast("double")) if p[1] == "log" else v.cast("double")
        bounds[p[0]] = (lo, hi)
        columns.append(F.coalesce(x.cast("double"), F.lit((lo + hi) / 2)).alias(p[0]))
    return trials.where("state = 'complete'").select(F.col("value").alias("y"), *columns), bounds


def parameter_importance(trials: DataFrame, space: list[tuple], n_trees: int = 16, depth: int = 6) -> DataFrame:
    """(param, importance) from a forest over a study's trial table."""
    from . import train
    from .trees import trees_of

    table, bounds = encoded(trials, space)
    forest = train.pipeline("rf", list(bounds), numTrees=n_trees, maxDepth=depth).fit(table)
    return importance(boxes_of(trials.sparkSession, trees_of(forest)[0], bounds))
