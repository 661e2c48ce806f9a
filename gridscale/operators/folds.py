"""Blocked folds in space and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def temporal_blocks(samples: DataFrame, n: int) -> DataFrame:
    """(t, block): distinct months in order in ``n`` equal blocks, the remainder in the last."""
    months = samples.select("t").distinct()  # the month axis
    ranked = months.withColumn("r", F.row_number().over(Window.orderBy("t")) - 1)
    size = months.agg(F.floor(F.count(F.lit(1)) / n).alias("size"))
    return ranked.crossJoin(F.broadcast(size)).select("t", F.least(F.floor(F.col("r") / F.greatest("size", F.lit(1))), F.lit(n - 1)).alias("block"))


def spatial_blocks(cells: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(i, j, block): k-means on distinct cells; blocks are numbered by their centres, south to north, west to east."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    distinct = cells.select("i", "j").distinct()
    n = distinct.count()
    if n < 2:
        raise ValueError("blocks need at least two distinct cells")
    x = VectorAssembler(inputCols=["i", "j"], outputCol="features").transform(distinct)
    model = KMeans(k=min(k, n), seed=seed).fit(x)
    order = sorted(range(len(model.clusterCenters())), key=lambda c: tuple(model.clusterCenters()[c]))
    number = F.create_map(*[F.lit(v) for pair in ((c, r) for r, c in enumerate(order)) for v in pair])
    return model.transform(x).select("i", "j", number[F.col("prediction")].alias("block"))


def roles(samples: DataFrame, centres: DataFrame, spans: DataFrame, space_buffer: float, time_buffer: int) -> DataFrame:
    """Samples (t, i, j, sb) x folds with ``role``: test, buffer or train.

    ``centres`` (sb, ci, cj) and ``spans`` (tb, t0, t1) have a row for each block. A sample is in the buffer when it
    lies near the test block's centre but not in it, or in a month within ``time_buffer`` of the test months.
    """
    folds = centres.withColumnRenamed("sb", "fsb").crossJoin(spans)
    n_time = spans.count()
    near = F.sqrt((F.col("i") - F.col("ci")) ** 2 + (F.col("j") - F.col("cj")) ** 2) < space_buffer
    same, in_test = F.col("sb") == F.col("fsb"), F.col("t").between(F.col("t0"), F.col("t1"))
    close = F.col("t").between(F.col("t0") - time_buffer, F.col("t1") + time_buffer) & ~in_test
    role = F.when(same & in_test, "test").when(close | (near & ~same), "buffer").otherwise("train")
    return samples.crossJoin(F.broadcast(folds)).withColumn("role", role).withColumn("fold", (F.col("fsb") * n_time + F.col("tb") + 1).cast("int"))


def composition(samples: DataFrame, centres: DataFrame, spans: DataFrame, space_buffer: float, time_buffer: int) -> DataFrame:
    """Like ``roles``, with the kind of buffer told apart: where several apply, temporal_buffer overrides
    spatial_buffer, that overrides test, and that train. The buffers hold no test sample, so both agree on the rest."""
    x = roles(samples, centres, spans, space_buffer, time_buffer)
    in_test = F.col("t").between(F.col("t0"), F.col("t1"))
    close = F.col("t").between(F.col("t0") - time_buffer, F.col("t1") + time_buffer) & ~in_test
    return x.withColumn("role", F.when(F.col("role") != "buffer", F.col("role")).when(close, "temporal_buffer").otherwise("spatial_buffer"))


def with_labels(samples: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with the block of their coordinates; ``labels`` has a row for each distinct coordinate."""
    return samples.join(labels, keys, "left")
