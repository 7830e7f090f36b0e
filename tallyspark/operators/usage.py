"""Usage events: one best event an attempt, totals by stage and model, latencies and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_attempts(events: DataFrame, attempt: str, reported, finished, order: list[str]) -> DataFrame:
    """One event an attempt: a reported usage beats none, finished beats started, then the latest wins.

    A late `started` never replaces a `finished`. The choice is an aggregation, so hot attempts combine map-side.
    """
    columns = [c for c in events.columns if c != attempt]
    best = F.max_by(F.struct(*columns), F.struct(reported.cast("int").alias("a"), finished.cast("int").alias("b"), *[F.col(c) for c in order]))
    return events.groupBy(attempt).agg(best.alias("e")).select(attempt, "e.*")


def usage_rollup(attempts: DataFrame, stage: str, model: str, counters: list[str], unknown) -> DataFrame:
    """Totals by stage, by model and over all, from one pass: rows (stage, model, attempts, unknown, counters...)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    out = attempts.groupingSets([[F.col(stage)], [F.col(model)], []], F.col(stage), F.col(model))
    return out.agg(F.count("*").alias("attempts"), F.count_if(unknown).alias("unknown"), *sums)


def latency_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, the value of rank (9 n + 9) // 10, and maximum.

    Equal values are counted first, map-side; ranks are running sums of these counts, so a group's window holds its
    distinct values only.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("m"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("k", F.sum("m").over(upto)).withColumn("n", F.sum("m").over(Window.partitionBy(group)))
    at = lambda k: F.min(F.when(F.col("k") >= k, F.col(value)))
    half = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return placed.groupBy(group).agg(F.max("n").alias("n_calls"), (F.sum(F.col(value) * F.col("m")) / F.sum("m")).alias("mean"), ((at(half[0]) + at(half[1])) / 2).alias("median"), at(F.floor((9 * F.col("n") + 9) / 10)).alias("p90"), F.max(value).alias("max"))


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int = 300) -> DataFrame:
    """Rows (user, started, ended, n): runs of events with no pause of `gap_seconds` or more."""
    w = F.session_window(ts, f"{gap_seconds} seconds")
    return events.groupBy(user, w.alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("w")


def wall_span(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    return rows.groupBy(group).agg((F.max(end).cast("timestamp").cast("double") - F.min(start).cast("timestamp").cast("double")).alias("seconds"), F.count_if(F.col(end).isNull()).alias("open"))


def cost(rows: DataFrame, group: str, tokens: str, price: str, surcharge_from: int, factor: float) -> DataFrame:
    """Cost of the attempts that have a price; long ones cost `factor` times as much."""
    each = F.col(tokens) * F.col(price) * F.when(F.col(tokens) >= surcharge_from, factor).otherwise(1.0)
    return rows.groupBy(group).agg(F.sum(each).alias("cost"), F.count_if(F.col(price).isNull()).alias("unpriced"))
