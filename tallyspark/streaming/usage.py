"""Usage events as a stream: exact dedupe, the best event of each attempt, and sessions.

Late events are merged, never dropped: the upsert keeps the better event whenever it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.usage import best_attempts


def events_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 100) -> DataFrame:
    """New files of a folder; those that were read are known from the checkpoint of the query."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def exactly_once(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """One event a key; repeats within the delay are dropped, so state stays bounded."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, user: str, ts: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def upsert_best(target: str, attempt: str, reported: Column, finished: Column, order: list[str], shards: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps the best event of each attempt in a table in the folder `target`.

    Attempts are spread over shards. A batch reads and rewrites only the shards that it touches, each into a folder of
    the batch's number. A list of the newest folder of each shard is written last, so work doesn't grow with the number
    of batches, and a batch that is repeated after a failure starts from the list before it and changes nothing.
    Readers use best_table(). Folders that no list names any more are left for the reader's retention to remove.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("shard", F.pmod(F.xxhash64(attempt), F.lit(shards)).cast("int"))
        newest = newest_batches(spark, target, before=number)
        touched = {r["shard"] for r in fresh.select("shard").distinct().collect()}  # a row a shard
        old = shard_rows(spark, target, {k: n for k, n in newest.items() if k in touched})
        both = fresh.unionByName(old.select(*fresh.columns)) if old is not None else fresh
        best = best_attempts(both, attempt, reported, finished, order)
        best.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{target}/batch={number}")
        listed = newest | dict.fromkeys(touched, number)
        spark.createDataFrame(list(listed.items()), "shard int, number long").coalesce(1).write.mode("overwrite").parquet(f"{target}/{LISTS}/batch={number}")
        for earlier in sorted(n for n in lists(spark, target) if n < number)[:-1]:  # the last one serves a repeat
            folder(spark, f"{target}/{LISTS}/batch={earlier}", delete=True)

    return step


LISTS = "_newest"


def folder(spark: SparkSession, path: str, delete: bool = False) -> list[str]:
    """The names in a folder, none if there is no such folder; with delete, the folder goes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    if delete:
        fs.delete(where, True)
    return names


def lists(spark: SparkSession, target: str) -> list[int]:
    """The batches that have a list; one that was not written whole doesn't count."""
    names = [n for n in folder(spark, f"{target}/{LISTS}") if n.startswith("batch=")]
    return [int(n.removeprefix("batch=")) for n in names if "_SUCCESS" in folder(spark, f"{target}/{LISTS}/{n}")]


def newest_batches(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """For each shard, the batch that wrote it last, of batches before the given one."""
    numbers = [n for n in lists(spark, target) if before is None or n < before]
    if not numbers:
        return {}
    rows = spark.read.schema("shard int, number long").parquet(f"{target}/{LISTS}/batch={max(numbers)}")
    return {r["shard"]: r["number"] for r in rows.collect()}  # a row a shard


def shard_rows(spark: SparkSession, target: str, newest: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/batch={number}/shard={shard}" for shard, number in newest.items()]
    return spark.read.option("basePath", target).parquet(*paths).drop("batch") if paths else None


def best_table(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest rows of every shard, of batches before the given one."""
    return shard_rows(spark, target, newest_batches(spark, target, before))


def keep_best(events: DataFrame, target: str, checkpoint: str, attempt: str, reported: Column, finished: Column, order: list[str]) -> DataStreamWriter:
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert_best(target, attempt, reported, finished, order))
