"""Connected components by alternating large-star and small-star steps, as joins and aggregations of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize

MOST_ROUNDS = 60


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """From edges (u, v), rows (u, v): each node but the smallest of its component, with that smallest node.

    Only minima of neighbours are aggregated, with partial aggregation, so a node with many links costs no task more.
    """
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    stamp = _stamp(now)
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = materialize(small, "edges")
        drop(now)
        now, before, stamp = after, stamp, _stamp(after)
        if stamp == before:
            return now
    raise RuntimeError("components did not settle")
