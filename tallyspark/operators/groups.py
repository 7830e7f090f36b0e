"""Groups: exact-sum subsets, competing lines, merged entries and sampled strata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cut import checkpointed, growing

MOST_MEMBERS = 12
WRAP = 1 << 40  # sums of a few residues fit 64 bits
FEW = 300_000  # edges that one task settles


def exact_subsets(members: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """Rows (bank_id, claim_group, items, total): subsets of two or more whose amounts sum exactly to the bank amount.

    members: bank_id, bank_amount, claim_group, item_id, amount. Groups of more than `most` need a reconciliation of
    their own and are left out. A group is at most `most` members, so its subsets are bit masks of one row.
    """
    known = members.filter(F.col("amount").isNotNull())
    sized = known.groupBy("bank_id", "claim_group").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most)).drop("n")
    rows = known.join(sized, ["bank_id", "claim_group"]).groupBy("bank_id", "claim_group", "bank_amount").agg(F.sort_array(F.collect_list(F.struct("item_id", "amount"))).alias("m"))
    # Sums of all subsets modulo WRAP, the place of each being its mask, are made by one addition each; only subsets that agree there are multiplied out.
    wrapped = lambda amount: F.coalesce(F.pmod((amount * 100).cast("bigint"), F.lit(WRAP)), F.lit(0))
    sums = F.aggregate(F.transform("m", lambda x: wrapped(x["amount"])), F.array(-wrapped(F.col("bank_amount"))), lambda acc, r: F.concat(acc, F.transform(acc, lambda s: s + r)))
    agreeing = F.array_compact(F.transform(sums, lambda s, mask: F.when(s % WRAP == 0, mask)))
    rows = rows.withColumn("mask", F.explode(agreeing)).filter(F.bit_count("mask") >= 2)
    chosen = F.filter("m", lambda x, i: F.getbit(F.col("mask"), i) == 1)
    rows = rows.withColumn("chosen", chosen)
    total = F.aggregate("chosen", F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + x["amount"]).cast("decimal(28,2)"))
    return rows.withColumn("total", total).filter(F.col("total") == F.col("bank_amount")).select("bank_id", "claim_group", F.transform("chosen", lambda x: x["item_id"]).alias("items"), F.col("total").cast("decimal(18,2)").alias("total"))


def first_owner(choices: DataFrame, top: int = 3) -> DataFrame:
    """Edges (bank_id, owner): each line and the first line that lists one of its best `top` candidates."""
    best = choices.filter(F.col("rank") <= top)
    owner = best.groupBy("item_id").agg(F.min("bank_id").alias("owner"))
    return best.join(growing(owner), "item_id").select("bank_id", "owner").distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str = "bank_id", rounds: int = 50) -> DataFrame:
    """Rows (node, component): the least node reachable by edges between nodes.

    In each round every node goes to its least neighbour, and on along these until nothing is smaller; then edges are drawn between where their
    ends came to, so what is left shrinks to a half at most, and only the first round handles all edges. Once FEW edges are left, one task settles them.
    Each round's tables are checkpointed, so that plans stay short and executors may be lost; none of them is broadcast.
    """
    a, b = edges.columns
    ends = lambda one, other: (F.greatest(one, other).alias("u"), F.least(one, other).alias("v"))
    left = checkpointed(edges.filter(F.col(a) != F.col(b)).select(*ends(a, b)).distinct())
    moves = []  # of each round, rows (u, c): where a node went
    while left.limit(FEW + 1).count() > FEW:
        if len(moves) == rounds:
            raise RuntimeError("components did not settle")
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moves.append(_lowest(checkpointed(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("c")))))
        went = lambda end: growing(moves[-1].select(F.col("u").alias(end), F.col("c").alias(f"_{end}")))
        left = checkpointed(left.join(went("u"), "u").join(went("v"), "v").filter("_u != _v").select(*ends("_u", "_v")).distinct())
    kind = left.schema["u"].dataType.simpleString()
    found = left.coalesce(1).mapInArrow(_settled, f"u {kind}, c {kind}")
    for move in reversed(moves):
        after = found.select(F.col("u").alias("c"), F.col("c").alias("_c"))
        found = move.join(growing(after), "c", "left").select("u", F.coalesce("_c", "c").alias("c"))
    lines = nodes.join(growing(found.withColumnRenamed("u", node)), node, "left")
    return checkpointed(lines.select(node, F.coalesce("c", node).alias("component")))


def _lowest(moves: DataFrame) -> DataFrame:
    """Moves (u, c) to smaller nodes, followed to their ends; where a node stays, its c is itself. Each step doubles how far it looks."""
    while True:
        on = moves.select(F.col("u").alias("c"), F.col("c").alias("_c"))
        moves = checkpointed(moves.join(growing(on), "c").select("u", F.col("_c").alias("c"), (F.col("c") != F.col("_c")).alias("moved")))
        moved, moves = moves.filter("moved").limit(1).count(), moves.select("u", "c")
        if not moved:
            return moves


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, c): of few edges (u, v), each node with the least of its component."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            one, other = top(u), top(v)
            up[max(one, other)] = min(one, other)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], ["u", "c"])


def merged_entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entries merged by key: amounts are summed if all are known, currencies must agree, texts are joined once each."""
    texts = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])), " / ")
    return rows.groupBy(*keys).agg(
        F.when(F.bool_and(F.col("amount").isNotNull()), F.sum("amount")).cast("decimal(18,2)").alias("amount"),
        F.when(F.count_distinct("currency") == 1, F.max("currency")).alias("currency"), texts.alias("text"), F.count("*").alias("n"),
    )


def bundled(documents: DataFrame) -> DataFrame:
    """Documents of one expense as one candidate: the first one's amount, all ids: (id, expense_id, pos, amount)."""
    key = F.coalesce(F.nullif(F.col("expense_id"), F.lit("")), F.col("id"))
    return documents.groupBy(key.alias("bundle")).agg(F.min_by(F.struct("id", "amount"), "pos").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("document_ids")).select("bundle", "first.id", "first.amount", "document_ids")


def stratified_sample(rows: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: int = 1) -> DataFrame:
    """A sampling operator: the first `sizes[stratum]` rows of each stratum in the order of a seeded hash."""
    want = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("_n", n).filter(F.col("_n") <= F.coalesce(want[F.col(stratum)], F.lit(0))).drop("_n")
