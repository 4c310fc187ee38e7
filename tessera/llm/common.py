"""Shared helpers: reading tables, scratch tables on shared storage, text cleaning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    return f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again.

    Lost executors cost a re-read of files, never a second run of what came before.
    The files go by ``done``, or else when the driver ends in order.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    system, target = _located(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def done(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` returned, once all that was made of them is written itself."""
    for df in tables:
        if path := df.__dict__.get("_scratch"):
            system, target = _located(df.sparkSession, path)
            system.delete(target, True)
            system.cancelDeleteOnExit(target)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB and 2000 rows for this session, unless it has limits of its own.

    Texts of a batch are Python objects while a worker handles them, so this bounds a worker's memory.
    """
    for name, usual, ours in (("maxBytesPerBatch", "67108864b", "8m"), ("maxRecordsPerBatch", "10000", "2000")):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_spaces(text: Column) -> Column:
    """Deletes the six white space characters, byte-wise and JVM-side."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else: the fast function where a string is all ASCII, a slower one where not."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def fresh(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` does not have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
