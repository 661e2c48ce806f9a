"""Block aggregation from the fine to the coarse grid."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def method_of(name: str, rules: list[tuple[str, str]], default: str = "mean") -> str:
    """Aggregation of a feature: that of the first pattern its name starts with."""
    return next((m for p, m in rules if re.match(p, name)), default)


def aggregate(name: str, method: str) -> Column:
    """Nulls are skipped; the sum of nothing is 0; of equally frequent values the smallest is the mode."""
    return {
        "mean": F.avg(name), "sum": F.coalesce(F.sum(name), F.lit(0.0)), "median": F.percentile(name, 0.5), "mode": F.mode(name, True), "max": F.max(name), "min": F.min(name),
    }[method].alias(name)


def coarsen(df: DataFrame, factor: int, methods: dict[str, str], n_rows: int, n_columns: int, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Blocks of ``factor`` x ``factor`` cells; rows and columns beyond a multiple of the factor are left out."""
    x = df.where((F.col("i") < n_rows // factor * factor) & (F.col("j") < n_columns // factor * factor))
    return x.groupBy(*keys, F.floor(F.col("i") / factor).cast("int").alias("ci"), F.floor(F.col("j") / factor).cast("int").alias("cj")).agg(*[aggregate(c, m) for c, m in methods.items()])
