"""Lineage cuts: tables in the folder that driver and executors share, which outlive lost executors.

A table is dropped once nothing reads it any more, and the rest when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, one process with all its executors gets a folder of its own; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wayfinder-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables under one name, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wayfinder/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def cut(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before the process does
            pass


_common: dict[str, Scratch] = {}


def cut(df: DataFrame) -> DataFrame:
    """`df` as a table that is dropped when the process ends."""
    app = df.sparkSession.sparkContext.applicationId
    if app not in _common:
        _common.clear()
        _common[app] = Scratch(df.sparkSession, "cuts")
    return _common[app].cut(df)
