"""Cutting lineage: tables that later steps read more than once are computed once and kept where executors may be lost."""

from __future__ import annotations

import gc
import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the folder of spark.checkpoint.dir; a temporary one where that is unset, on local masters only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    kept = df.checkpoint()
    release(df.sparkSession)
    return kept


def release(spark: SparkSession) -> None:
    """Let Spark remove the files of finished exchanges that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: its compressed files look small, and broadcast it would pass whole through the driver."""
    return df.hint("merge")


def measured(df: DataFrame, most: int = 300_000) -> DataFrame:
    """A side of a join that is small as a rule: written, counted, and broadcast if it has at most `most` rows; else it is one that grows."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else growing(kept)


def spread(df: DataFrame, *keys: str, most: int = 250_000) -> DataFrame:
    """The rows, those of equal keys in one partition, some `most` rows a partition: with the table their number grows, not what a task holds.

    The rows are counted first, so this is for tables as they are read, whose files tell the count.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / most)), *keys)
