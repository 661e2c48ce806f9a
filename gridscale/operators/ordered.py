"""Numbers and running maxima along long orders, in tasks of bounded size."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a stretch of the order, and of a task on average.
STRETCH = 250_000


def _stretched(df: DataFrame, key: str, stretch: int) -> tuple[DataFrame, int]:
    """``df`` with ``_part``: the stretch of the numeric ``key`` in which a row falls, null keys last; and how many there are."""
    n = df.count() // stretch + 1
    at = [k / n for k in range(1, n)]
    cuts = df.agg(F.percentile_approx(key, at, max(10_000, 20 * n)).alias("c")).first()["c"] if at else None  # one number for each stretch
    ends = [float("-inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    x = Bucketizer(splits=ends, inputCol=key, outputCol="_part", handleInvalid="keep").transform(df)
    return x.withColumn("_part", F.coalesce(F.col("_part").cast("int"), F.lit(len(ends)))), n


def numbered(df: DataFrame, by: list[str], order: list[str], number: str, running: dict[str, str] | None = None, stretch: int | None = None) -> DataFrame:
    """``df`` with ``number``: 1, 2, 3, ... in ``order`` (nulls last, the first column numeric) within each group of ``by``,
    and for each ``{new: value}`` of ``running`` the largest value up to the row.

    The order is cut into stretches of some ``stretch`` rows, one or some of which a task sorts; what the stretches before
    add up to, one row for each group and stretch, is broadcast. Rows with the same first column stay in one stretch.
    """
    running = running or {}
    x, n = _stretched(df, order[0], stretch or STRETCH)
    sums = x.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.max(v).alias(f"_{c}") for c, v in running.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_part"]
    first = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), *[F.max(f"_{c}").over(before).alias(f"_{c}") for c in running])
    own = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    x = x.repartition(n, *keys).withColumns({"_own": F.row_number().over(own), **{c: F.max(v).over(so_far) for c, v in running.items()}})
    x = x.join(F.broadcast(first), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return x.select(*df.columns, (F.col("_first") + F.col("_own")).cast("long").alias(number), *[F.greatest(F.col(c), F.col(f"_{c}")).alias(c) for c in running])
