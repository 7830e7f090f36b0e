"""Exact duplicates, inventories and drift between what is indexed and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import missing_and_unknown


def duplicate_groups(files: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (sha256, key, copies, copy) of contents that occur twice or more; copies are numbered by key.

    Contents whose length is unique are never hashed.
    """
    sized = files.withColumn("bytes", F.octet_length(content))
    often = sized.groupBy("bytes").agg(F.count("*").alias("n")).filter("n > 1").select("bytes")
    hashed = sized.join(often, "bytes").select(key, F.upper(F.sha2(F.col(content).cast("binary"), 256)).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.count("*").alias("copies")).filter("copies > 1")
    copies = hashed.join(groups, "sha256")
    return copies.withColumn("copy", F.row_number().over(Window.partitionBy("sha256").orderBy(key)))


def duplicate_summary(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row: files, groups, copies in groups, extra copies, and distinct contents."""
    by = files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("copies"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"), F.count("*").alias("unique_documents"),
    )


def inventory(files: DataFrame, path: str, content: str) -> DataFrame:
    """Rows (sha256, paths): each distinct content with its sorted paths."""
    return files.groupBy(F.upper(F.sha2(F.col(content).cast("binary"), 256)).alias("sha256")).agg(F.sort_array(F.collect_list(path)).alias("paths"))


def source_drift(indexed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return missing_and_unknown(indexed, present, key)


def unmatched(inventory_: DataFrame, matched: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """What is in the inventory and neither matched nor a removed copy whose keeper is there: removed has (key, keeper)."""
    alive = removed.join(inventory_.select(F.col(key).alias("keeper")), "keeper", "left_semi")
    return inventory_.join(matched.select(key), key, "left_anti").join(alive.select(key), key, "left_anti")


def removal_conflicts(removed: DataFrame, key: str, keeper: str) -> DataFrame:
    """Rows (key, conflict): a loser with two keepers, or a keeper that is a loser itself."""
    two = removed.groupBy(key).agg(F.count_distinct(keeper).alias("n")).filter("n > 1").select(key, F.lit("two keepers").alias("conflict"))
    losing = removed.select(F.col(keeper).alias(key)).distinct().join(removed.select(key), key, "left_semi").select(key, F.lit("keeper is removed").alias("conflict"))
    return two.unionByName(losing)


def inventory_rows(documents: DataFrame, units: DataFrame) -> DataFrame:
    """One row for each path of a document and each of its units: documents (id, path), units (id, unit_no, text).

    Paths are numbered by a window, which may spill, and not gathered in one row.
    """
    copy = F.row_number().over(Window.partitionBy("id").orderBy("path")) - 1
    paths = documents.select("id", "path", copy.alias("copy"))
    return paths.join(units, "id").withColumn("duplicate", F.col("copy") > 0)
