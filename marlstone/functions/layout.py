"""How rows lie over the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files have fewer splits than that: for rows that mean much work each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can read.

    A local folder is made only where none is set and all is on one machine, as in tests.
    """
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written where every executor can read it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """The state of a loop, written as a table in every round, so plans and estimates of size start anew; older rounds are removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{self.n}")
        if self.n > 1:  # the last one may still be read
            self.drop(self.n - 2)
        self.n += 1
        return self.spark.read.parquet(f"{self.folder}/{self.n - 1}")

    def drop(self, n: int) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
