"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); the component is the smallest node it reaches.

    Null ends and loops are left out. Each round is two joins on aggregated minima, which broadcast all
    minima while they are few and those of hubs else; nothing is collected but two checksums, and rounds grow with the logarithm of the longest path.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    e, before = cut(e), None
    while True:
        both = e.union(e.select("m", "v")).toDF("u", "v")
        lows = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = join_counted(both, lows, "u", "n").where("v > u").select("v", "m").where("v <> m")
        lows = cut(large.groupBy("v").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("n")))
        small = join_counted(large, lows, "v", "n").select(F.explode(F.array(F.struct(F.col("v"), F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("x")).select("x.*")
        e = cut(small.where("v <> m").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy("v").agg(F.min("m").alias("m")).select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.col("m").alias("component")), F.struct(F.col("m").alias("node"), F.col("m").alias("component")))).alias("x")).select("x.*").distinct()
