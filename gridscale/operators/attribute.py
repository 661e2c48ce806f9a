"""Sampled Shapley attributions of a fitted pipeline, and summaries of attribution tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shapley(model: PipelineModel, samples: DataFrame, background: DataFrame, features: list[str], rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(sample_id, feature, x, phi) and (sample_id, base, prediction).

    Each sample meets ``rounds`` background rows in a permutation of the features that a
    hash of sample and round gives; features switch from the background's value to the sample's one by one, all
    mixtures are predicted in one transform, and the steps are averaged. Steps of a round add up to the
    difference of its two ends, so base plus attributions is the prediction exactly.
    """
    n = len(features)
    b = background.limit(rounds).withColumn("_round", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*features)) - 1)  # ``rounds`` rows
    pairs = samples.select("sample_id", *features).crossJoin(F.broadcast(b.select("_round", *[F.col(f).alias(f"_{f}") for f in features])))
    order = F.array_sort(F.array(*[F.struct(F.xxhash64("sample_id", "_round", F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(n)]))
    ranked = pairs.withColumn("_order", F.transform(order, lambda s: s["k"]))
    steps = ranked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    mixed = steps.select("sample_id", "_round", "step", F.when(F.col("step") > 0, F.get("_order", F.col("step") - 1)).alias("_k"), *[F.when(F.array_position("_order", F.lit(k)) <= F.col("step"), F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for k, f in enumerate(features)])
    told = model.transform(mixed).select("sample_id", "_round", "step", "_k", "prediction")
    w = Window.partitionBy("sample_id", "_round").orderBy("step")
    gains = told.withColumn("gain", F.col("prediction") - F.lag("prediction").over(w)).where("step > 0")
    names = F.array(*[F.lit(f) for f in features])
    phi = gains.groupBy("sample_id", "_k").agg(F.avg("gain").alias("phi")).select("sample_id", F.get(names, F.col("_k")).alias("feature"), "phi")
    ends = told.groupBy("sample_id").agg(F.avg(F.when(F.col("step") == 0, F.col("prediction"))).alias("base"), F.avg(F.when(F.col("step") == n, F.col("prediction"))).alias("prediction"))
    x = samples.select("sample_id", *features).unpivot(["sample_id"], features, "feature", "x")
    return phi.join(x, ["sample_id", "feature"]).select("sample_id", "feature", "x", "phi"), ends


def interactions(model: PipelineModel, samples: DataFrame, background: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, strength): mean absolute second difference of the prediction for every pair of features."""
    base = background.agg(*[F.avg(f).alias(f"_{f}") for f in features])
    x = samples.select("sample_id", *features).crossJoin(F.broadcast(base))
    pairs = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b")) for p, q in combinations(features, 2)])
    corners = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0, 1) for q in (0, 1)])
    x = x.withColumn("pair", F.explode(pairs)).withColumn("corner", F.explode(corners)).select("sample_id", "pair.*", "corner.*", *features, *[f"_{f}" for f in features])
    on = lambda f: ((F.col("a") == f) & (F.col("p") == 1)) | ((F.col("b") == f) & (F.col("q") == 1))
    mixed = x.select("sample_id", "a", "b", "p", "q", *[F.when(on(f), F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in features])
    told = model.transform(mixed).select("sample_id", "a", "b", (F.when(F.col("p") == F.col("q"), 1).otherwise(-1) * F.col("prediction")).alias("v"))
    return told.groupBy("sample_id", "a", "b").agg(F.sum("v").alias("d")).groupBy("a", "b").agg(F.avg(F.abs("d")).alias("strength"))


def importance(phi: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean absolute attribution of each feature, and its rank within ``by``."""
    x = phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")))


def group_importance(phi: DataFrame, groups: dict[str, str], by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean over samples of the summed absolute attribution of each name group; groups may overlap, the rest is Other."""
    hits = F.array_compact(F.array(*[F.when(F.col("feature").rlike(p), F.lit(g)) for g, p in groups.items()]))
    x = phi.withColumn("group", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("Other")))))
    return x.groupBy(*by, "group", "sample_id").agg(F.sum(F.abs("phi")).alias("s")).groupBy(*by, "group").agg(F.avg("s").alias("importance"))
