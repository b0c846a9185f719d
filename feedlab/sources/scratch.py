"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local folder serves local masters; on a cluster each executor would write to a disk of its
    own, so there RuntimeError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/feedlab/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: computed once, whoever reads them."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``keep(df, part)`` stores tables that are deleted when the block ends: nothing computed later may read them."""
    top = shared_dir(spark, name)

    def keep(df: DataFrame, part: str) -> DataFrame:
        path = f"{top}/{part}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        there = spark._jvm.org.apache.hadoop.fs.Path(top)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
