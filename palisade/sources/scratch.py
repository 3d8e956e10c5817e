"""Folders for what a query keeps while it runs, where all executors and the driver can read it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one of our own where it is unset and all tasks
    run in this process, as in tests. On a cluster that names none this is an error: executors don't share local folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/palisade/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)

    atexit.register(end)
    return path
