"""Streams over a table that is there already, run to their end."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; its path is given as a pattern, since a plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def in_pieces(spark: SparkSession, rows: DataFrame, parts: int) -> DataFrame:
    """rows as a stream of at least `parts` micro-batches, dealt by a hash of whole rows, so in no order of theirs."""
    folder = scratch(spark)
    dealt = F.pmod(F.xxhash64(*rows.columns, F.lit(7)), F.lit(parts))
    rows.repartition(parts, dealt).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


#: What keyed state in Python needs. State that expires by the clock would keep a replay running through batches without data.
STATEFUL = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The session with these settings, which are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drained(spark: SparkSession, made: DataFrame, mode: str = "append", **conf: str) -> DataFrame:
    """The rows of a stream run to its end, each with the number of its micro-batch, written as Parquet and read back."""
    folder = scratch(spark)
    with settings(spark, conf):
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        made.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(T.StructType([*made.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/out")


def replay(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append", **conf: str) -> DataFrame:
    """The rows that plan gives over path as a stream, written batch by batch as Parquet and read back."""
    made = plan(stream_of(spark, path))
    return drained(spark, made, mode, **conf).select(*made.columns)
