"""Scratch storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    jdir = context._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path of its own there; what is written to it goes when the driver ends in order."""
    path = f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what was written to ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(target, True)
    system.cancelDeleteOnExit(target)
