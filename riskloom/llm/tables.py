"""Intermediate tables in the shared folder, and models sent to workers."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from riskloom.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, which cuts the lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast of an object of this package together with its class, for workers that have no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    """The object of a broadcast made by ``shipped``; call it once a task."""
    return cloudpickle.loads(sent.value)
