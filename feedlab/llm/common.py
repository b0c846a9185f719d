"""Pieces shared by the training-data operators: words, folders that all executors share, row-wise "let"."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word.
SPACES = " \t\n\x0b\f\r"
SPACES_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES_RE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


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


#: Writer's options for tables of many equal 64-bit values: dictionaries of up to a million values.
COMPACT = {"parquet.dictionary.page.size": str(8 << 20), "compression": "zstd"}


def stored(df: DataFrame, name: str, *folders: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: cuts the lineage and survives lost executors.

    ``folders``: columns whose values get folders of their own, of which a filter on them reads those it needs.
    """
    return _written(df, shared_dir(df.sparkSession, name), *folders, options=options)


def _written(df: DataFrame, path: str, *folders: str, options: dict[str, str] | None = None) -> DataFrame:
    df.write.options(**(options or {})).partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, times: int = 1) -> None:
    """Let Spark delete the shuffle files of jobs that are over, which it does once the driver's garbage is collected.

    Those of the last job may need ``times`` of 2, as the first lets go of what Python's objects hold.
    """
    for i in range(times):
        if i:
            time.sleep(0.1)
        gc.collect()
        spark._jvm.System.gc()


#: Tables after which ``Scratch`` lets Spark delete shuffle files.
SWEEP_EACH = 6


class Scratch:
    """Tables that are stored for the length of a ``with`` block; ``drop`` deletes one sooner.

    Nothing that is still to be computed when the block ends may read them: store a result outside of it first.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.top = spark, shared_dir(spark, name)
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}-{len(self.paths)}"
        out = _written(df, path)
        self.paths[id(out)] = (out, path)
        if len(self.paths) % SWEEP_EACH == 0:
            self.sweep()
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.paths:
                self._delete(self.paths[id(table)][1])

    def sweep(self) -> None:
        sweep(self.spark)

    def _delete(self, path: str) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.top)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
