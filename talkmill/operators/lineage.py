"""Cutting lineage in iterative operators, with files that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which the driver and all executors see: spark.checkpoint.dir. A local
    session (tests) gets a folder of its own where that is unset; a cluster without it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """The table that an iteration hands from round to round, in the shared folder: each new one replaces the last."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read back; the files of the round before it go."""
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        if self.n:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n - 1}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)
