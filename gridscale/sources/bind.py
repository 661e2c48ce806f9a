"""Grid tables bound to the driver's tables, and the same tables as SQL.

The fine grid has 20 x 20 cells and a month axis counted from 1995-01; a coarse cell is 5 x 5 fine cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, FACTOR = 20, 5
LAT0, LON0, STEP = 28.525, -113.975, 0.05


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def month_index(ts):
    return ((F.year(ts) - 1995) * 12 + F.month(ts) - 1).cast("int")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine monthly cells that have data."""
    x = read(spark, sf_dir, "lineitem").select(
        month_index(F.col("l_shipdate")).alias("t"), (F.col("l_partkey") % SIDE).cast("int").alias("i"), (F.floor(F.col("l_partkey") / SIDE) % SIDE).cast("int").alias("j"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )
    return x.groupBy("t", "i", "j").agg(
        F.avg("l_extendedprice").alias("value"), F.sum("l_quantity").alias("pr"), (F.min("l_discount") * 100).alias("tmmn"), (F.max("l_discount") * 100).alias("tmmx"),
        (F.avg("l_tax") * 100).alias("aet"), F.count(F.lit(1)).cast("double").alias("chirps"),
    )


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second product on the same cells, from orders."""
    x = read(spark, sf_dir, "orders").select(month_index(F.col("o_orderdate")).alias("t"), (F.col("o_custkey") % SIDE).cast("int").alias("i"), (F.floor(F.col("o_custkey") / SIDE) % SIDE).cast("int").alias("j"), "o_totalprice")
    return x.groupBy("t", "i", "j").agg(F.avg("o_totalprice").alias("other"))


def on_spine(cells: DataFrame) -> DataFrame:
    """``cells`` on the full product of its cells and months; absent months are null."""
    ends = cells.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b")).alias("t"))
    keys = cells.select("i", "j").distinct().crossJoin(F.broadcast(months))  # the month axis: some hundreds of rows
    return keys.join(cells, ["t", "i", "j"], "left")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spine(observed(spark, sf_dir))


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell: land cover class, population and elevation."""
    p = read(spark, sf_dir, "part")
    x = p.groupBy((F.col("p_partkey") % SIDE).cast("int").alias("i"), (F.floor(F.col("p_partkey") / SIDE) % SIDE).cast("int").alias("j")).agg(
        F.sum("p_size").cast("double").alias("population"), F.avg("p_retailprice").alias("elevation")
    )
    return x.withColumn("land_cover", 1 + (F.col("i") * SIDE + F.col("j")) % 17)


def coarse(df: DataFrame, *aggregates) -> DataFrame:
    return df.groupBy("t", F.floor(F.col("i") / FACTOR).cast("int").alias("ci"), F.floor(F.col("j") / FACTOR).cast("int").alias("cj")).agg(*aggregates)


_BASE = """obs AS (SELECT CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1 AS INT) AS t, CAST(l_partkey % 20 AS INT) AS i, CAST((l_partkey // 20) % 20 AS INT) AS j,
  l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem),
fine AS (SELECT t, i, j, avg(l_extendedprice) AS value, sum(l_quantity) AS pr, 100*min(l_discount) AS tmmn, 100*max(l_discount) AS tmmx, 100*avg(l_tax) AS aet, CAST(count(*) AS DOUBLE) AS chirps FROM obs GROUP BY t, i, j),
cells AS (SELECT DISTINCT i, j FROM fine),
months AS (SELECT CAST(unnest(range((SELECT min(t) FROM fine), (SELECT max(t) FROM fine)+1)) AS INT) AS t),
signal AS (SELECT m.t, c.i, c.j, f.value, f.pr, f.tmmn, f.tmmx, f.aet, f.chirps FROM cells c CROSS JOIN months m LEFT JOIN fine f USING (t, i, j)),
second AS (SELECT CAST((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS INT) AS t, CAST(o_custkey % 20 AS INT) AS i, CAST((o_custkey // 20) % 20 AS INT) AS j, avg(o_totalprice) AS other FROM orders GROUP BY ALL),
static AS (SELECT CAST(p_partkey % 20 AS INT) AS i, CAST((p_partkey // 20) % 20 AS INT) AS j, CAST(sum(p_size) AS DOUBLE) AS population, avg(p_retailprice) AS elevation,
  1 + (i*20+j) % 17 AS land_cover FROM part GROUP BY 1, 2),
coarse AS (SELECT t, i // 5 AS ci, j // 5 AS cj, avg(value) AS value, coalesce(sum(pr), 0) AS pr FROM signal GROUP BY 1, 2, 3)"""


def sql(body: str, *more: str) -> str:
    """``body`` with the bound tables, and ``more`` tables after them, in reach."""
    return "WITH " + ",\n".join([_BASE, *more]) + "\n" + body
