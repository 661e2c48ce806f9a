"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a few numbers each that may be broadcast; some MB, for a driver holds many such tables in the course of a job.
SMALL = 40_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt evenly if its files split into fewer tasks than there are cores, as one small file does.

    Tables of any size worth a cluster split finely enough and stay as they are.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a temporary folder
    serves in local mode, whose executors are in the driver; on a cluster it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that lineage ends here.

    Later reads take the columns they need only. The files go when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps within each group, in no task more than a bucket of a group.

    Rows are dealt to ``buckets`` by a hash of ``order``; the counts of all (group, bucket) pairs, at most
    groups x buckets rows, give each bucket its first number and are broadcast.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        df.withColumn("_own", F.row_number().over(own) - 1)
        .join(F.broadcast(firsts), [*group, "_bucket"])
        .withColumn(out, (F.col("_first") + F.col("_own")).cast("long"))
        .drop("_bucket", "_own", "_first")
    )


def join_few(rows: DataFrame, few: DataFrame, keys: str | list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """``rows`` joined with ``few``, which is counted first and broadcast up to ``most`` rows; it should be cut."""
    return rows.join(F.broadcast(few) if few.count() <= most else few, keys, how)


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``counted``, which has each ``key`` once with its number ``n`` of rows.

    Up to SMALL keys are broadcast. Of more, those of more than a thousandth of the rows, a thousand at most, are
    broadcast, so that no task gets all rows of such a key, and the others are shuffled. ``counted`` should be cut.
    """
    keys, total = counted.agg(F.count(F.lit(1)), F.sum(n)).first()
    if keys <= SMALL:
        return rows.join(F.broadcast(counted), key)
    hub = F.col(n) > max((total or 0) // 1000, 100)
    light = rows.join(F.broadcast(counted.where(hub).select(key)), key, "left_anti")
    return light.join(counted.where(~hub), key).unionByName(rows.join(F.broadcast(counted.where(hub)), key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 500, size: str = "16m") -> Iterator[None]:
    """Smaller Arrow batches for jobs run inside, so that Python workers hold few whole texts at a time: at most
    ``rows`` rows and, but for one longer text, ``size`` bytes."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
