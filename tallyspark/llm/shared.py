"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def tidy() -> None:
    """Give back what a Python worker has freed: workers live on beside those of later stages, and freed memory would stay theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy_after(run: Callable) -> Callable:
    """A function of batches that tidies up when its task ends."""

    @functools.wraps(run)
    def tidied(*args):
        try:
            yield from run(*args)
        finally:
            tidy()

    return tidied


def tidy_group(made: Callable) -> Callable:
    """A function of one group that tidies up after it."""

    def tidied(pdf):
        try:
            return made(pdf)
        finally:
            tidy()

    return tidied


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Remove a materialized table that no later frame reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
