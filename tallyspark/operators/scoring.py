"""Scoring of strategies against a truth: overlaps, recall, agreement and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_overlap(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, shared, n_left, n_right): the size of the multiset intersection of the values."""
    count = lambda rows, name: rows.groupBy(key, value).agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), [key, value], "full_outer").fillna(0, ["l", "r"])
    return both.groupBy(key).agg(F.sum(F.least("l", "r")).alias("shared"), F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def recall(expected: DataFrame, visible: DataFrame, key: str, item: str) -> DataFrame:
    """One row: keys, and those of which all expected items are visible."""
    seen = visible.select(key, item).distinct().withColumn("_seen", F.lit(True))
    by = expected.join(seen, [key, item], "left").groupBy(key).agg(F.bool_and(F.coalesce("_seen", F.lit(False))).alias("complete"))
    return by.agg(F.count("*").alias("keys"), F.count_if("complete").alias("complete"))


def strategy_pivot(rows: DataFrame, key: str, strategy: str, value: str, strategies: list[str]) -> DataFrame:
    return rows.groupBy(key).pivot(strategy, strategies).agg(F.max(value))


def signature(allocations: DataFrame, keys: list[str], item: str, amount: str) -> DataFrame:
    """A hash of the sorted allocations of each key."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct(F.col(item).cast("string").alias("i"), F.col(amount).cast("string").alias("a")))), lambda x: F.concat_ws("=", x["i"], x["a"]))
    return allocations.groupBy(*keys).agg(F.sha2(F.array_join(pairs, ";").cast("binary"), 256).alias("signature"))


def agreement(signatures: DataFrame, key: str) -> DataFrame:
    return signatures.groupBy(key).agg(F.count_distinct("signature").alias("variants"), F.count("*").alias("strategies"))


def decision_scores(truth: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """One row: correct, safe (tentative where a proposal was due), unsafe (a wrong proposal) and missing lines."""
    both = truth.join(decisions, key, "left")
    proposed = F.col("assessment") == "strong"
    right = proposed & (F.col("items") == F.col("truth_items"))
    return both.agg(F.count_if(right).alias("correct"), F.count_if(F.col("assessment").isNotNull() & ~proposed).alias("safe"), F.count_if(proposed & ~right).alias("unsafe"), F.count_if(F.col("assessment").isNull()).alias("missing"))


def level_counts(rows: DataFrame, level: str, levels: list[str]) -> DataFrame:
    """A row for every level, those without rows at zero."""
    fixed = rows.sparkSession.createDataFrame([(x,) for x in levels], f"{level} string")
    return fixed.join(rows.groupBy(level).agg(F.count("*").alias("n")), level, "left").fillna(0, ["n"])


def path_rollup(rows: DataFrame, path: str) -> DataFrame:
    """Rows (folder, n): how many rows are at or below each folder of their paths."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def revision(*columns: Column) -> Column:
    """A content hash of the columns in the order given; unknown and empty values differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
