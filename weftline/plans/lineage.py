"""Cutting lineage by tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where a session of one machine names none, as in a local test, a temporary
    folder serves; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), f"weftline-{spark.sparkContext.applicationId}")


#: Folders that each thread has named in the shared folder and not deleted; queries that run side by side have threads of their own.
_OWN = threading.local()


def _paths() -> list[str]:
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def fresh_path(spark: SparkSession, tag: str) -> str:
    _paths().append(f"{shared_dir(spark).rstrip('/')}/weftline-{tag}-{uuid.uuid4().hex}")
    return _paths()[-1]


def named() -> list[str]:
    """The folders that this thread has named so far, oldest first."""
    return list(_paths())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whichever store it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` gave."""
    delete(spark, path)
    if path in _paths():
        _paths().remove(path)


def clean_up(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables of this thread but for ``keep``; results that still read from them are then gone too."""
    for path in named():
        if path not in keep:
            discard(spark, path)


def written(df: DataFrame, tag: str = "cut", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one query, by name in a folder of its own.

    They are kept with their query, so queries that run side by side don't meet.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.paths = spark, fresh_path(spark, tag), {}

    def path(self, name: str) -> str:
        self.paths[name] = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        return self.paths[name]

    def written(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """``df`` computed once, as the table ``name``."""
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, self.paths.pop(name))

    def close(self) -> None:
        discard(self.spark, self.folder)
