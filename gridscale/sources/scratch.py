"""Tables written in passing, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


class Written:
    """A table that was written as Parquet, in a folder for each value of ``by`` if wanted, and is read from there until
    ``drop``; it goes with the application at the latest."""

    def __init__(self, df: DataFrame, by: list[str] | None = None):
        self.spark = df.sparkSession
        self.folder = f"{shared_folder(self.spark)}/written-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(self.folder)
        self.table = self.spark.read.schema(df.schema).parquet(self.folder)
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._store = self._path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._store.deleteOnExit(self._path)

    def drop(self) -> None:
        self._store.delete(self._path, True)
