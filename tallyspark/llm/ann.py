"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted in numpy on at most SAMPLE vectors; every vector is then indexed, that is sent down to its leaf.
A query walks the tree through a priority queue, best bin first, and lists the leaves in the order in which it would
visit them; a bin is as good as the inner product that a vector WIDE standard deviations above its mean would have,
by the bin's main axes. How many of them it does visit is calibrated: for a bounded number of queries
the true neighbours are found by brute force over all vectors, and visits are widened until the recall of those
queries reaches RECALL. Neighbouring leaves make up shards of bounded size, and a leaf that is larger is cut over
several; a query goes once to each shard that has some of its leaves, with the list of these, and meets the vectors of
these leaves only. The queries of a shard are cut into blocks too, so no leaf makes a large task.

Equal vectors are one point of the index with its k + 1 smallest ids, and equal queries are searched once, so a
vector that a third of the rows hold costs no more than another. Scores are computed anew in double precision from
the original vectors.

Defined results: vectors that are null, empty, zero, of another length than most
vectors have, or that hold null or
non-finite components take no part, nor do rows with a null id; equal rows count once; a query never finds its own
id; ties go to the smaller id; fewer than k candidates give fewer rows; no vectors give no rows. Other columns aren't
read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, shuffle_partitions, table

SAMPLE = 20_000
SAMPLE_BYTES = 1 << 28
CALIBRATION = 256
RECALL = 0.96
BRANCH = 8
MOST_LEAVES = 4096
SHARD = 65_536  # vectors, if they are short
SHARD_BYTES = 1 << 25  # of a shard's vectors in double precision
BLOCK = 4096
ASK_BYTES = 1 << 25
AXES = 8
WIDE = 3.0


@dataclass
class Tree:
    centers: np.ndarray
    axes: np.ndarray  # of each node, its main axes, each as long as the standard deviation along it
    rest: np.ndarray  # standard deviation in any other direction
    children: list[list[int]]  # empty: a leaf
    leaf: np.ndarray  # number of the leaf, or -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                own = inner[at[inner] == node]
                kids = np.array(self.children[node])
                c = self.centers[kids]
                at[own] = kids[np.argmax(x[own] @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)]

    def visits(self, q: np.ndarray, most: int) -> np.ndarray:
        """For each query, its first `most` leaves, best bin first."""
        out = np.empty((len(q), most), np.int32)
        for a in range(0, len(q), 128):
            own = q[a : a + 128]
            along = np.square(own @ self.axes.reshape(-1, own.shape[1]).T).reshape(len(own), len(self.centers), -1).sum(axis=2)
            spread = np.sqrt(along + np.square(own).sum(axis=1)[:, None] * self.rest**2)
            for k, row in enumerate((-(own @ self.centers.T + WIDE * spread)).tolist(), a):
                queue, n = [(0.0, 0)], 0
                while n < most:
                    _, node = heapq.heappop(queue)
                    if self.leaf[node] >= 0:
                        out[k, n] = self.leaf[node]
                        n += 1
                    for child in self.children[node]:
                        heapq.heappush(queue, (row[child], child))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cluster of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def main_axes(y: np.ndarray) -> tuple[np.ndarray, float]:
    """The AXES main axes of centred vectors, scaled by their standard deviations, and the deviation in any other direction."""
    n, size = y.shape
    if n >= size:
        values, vectors = np.linalg.eigh(y.T @ y / n)
        axes = (vectors * np.sqrt(np.maximum(values, 0))).T[::-1][:AXES]
    else:
        axes = (np.linalg.eigh(y @ y.T)[1].T @ y)[::-1][:AXES] / np.sqrt(n)
    out = np.zeros((AXES, size))
    out[: len(axes)] = axes
    left = np.square(y).sum() / n - np.square(out).sum()
    return out, float(np.sqrt(max(left, 0.0) / size))


def fit_tree(x: np.ndarray, leaves: int, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    centers, axes, rest, children, leaf, n = [], [], [], [], [], 0

    def grow(rows: np.ndarray, most: int) -> int:
        nonlocal n
        node = len(centers)
        center = x[rows].mean(axis=0)
        centers.append(center)
        for column, value in zip((axes, rest), main_axes(x[rows] - center), strict=True):
            column.append(value)
        children.append([])
        leaf.append(-1)
        if most > 1 and len(rows) >= 2 * BRANCH:
            own = kmeans(x[rows], min(BRANCH, most), rng)
            parts = [rows[own == k] for k in np.unique(own)]
            if len(parts) > 1:
                children[node] = [grow(p, max(1, round(most * len(p) / len(rows)))) for p in parts]
                return node
        leaf[node] = n
        n += 1
        return node

    grow(np.arange(len(x)), leaves)
    return Tree(np.array(centers), np.array(axes), np.array(rest), children, np.array(leaf))


def is_usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def as_matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def packed(index: DataFrame, size: int) -> DataFrame:
    """(id, vector) with the vector as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "v"])

    return index.mapInArrow(run, "id long, v binary")


def best(scores: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, scored anew in double precision; ties to the smaller id. Scores of -inf don't count."""
    met = np.flatnonzero(scores > -np.inf)
    scores = scores[met]
    if len(scores) > k:
        at = np.argpartition(-scores, k - 1)[:k]
        at = np.flatnonzero(scores >= scores[at].min() - 1e-9 * (1 + abs(scores[at].min())))
    else:
        at = np.arange(len(scores))
    at = met[at]
    exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def brute_force(points: DataFrame, queries: list[tuple[int, bytes]], size: int, k: int) -> dict[int, list[tuple[int, int]]]:
    """For a bounded list of queries, their k nearest over all points: {query: [(id, leaf)]}."""
    ids, q = np.array([i for i, _ in queries]), np.frombuffer(b"".join(v for _, v in queries), np.float64).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x, leaf = batch.column(0).to_numpy(), as_matrix(batch.column(1), size), batch.column(2).to_numpy()
            where = dict(zip(own.tolist(), leaf.tolist(), strict=True))
            scores, rows = x @ q.T, []
            for j, query in enumerate(ids.tolist()):
                rows += [(query, i, s, where[i]) for i, s in zip(*(a.tolist() for a in best(scores[:, j], x, q[j], own, k + 1)), strict=True) if i != query]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], ["q", "id", "score", "leaf"])

    found = points.select("id", "v", "leaf").mapInArrow(run, "q long, id long, score double, leaf int")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k)
    out: dict[int, list[tuple[int, int]]] = {i: [] for i in ids.tolist()}
    for r in top.collect():  # k rows a calibration query
        out[r["q"]].append((r["id"], r["leaf"]))
    return out


def widened(tree: Tree, queries: list[tuple[int, bytes]], truth: dict[int, list[tuple[int, int]]], size: int, recall: float) -> int:
    """The least number of leaf visits, by a widening series, with which the calibration queries reach the recall."""
    q = np.frombuffer(b"".join(v for _, v in queries), np.float64).reshape(-1, size)
    order, visits = tree.visits(q, tree.leaves), 1
    while visits < tree.leaves:
        got = [np.isin([leaf for _, leaf in truth[i]], order[k, :visits]).mean() for k, (i, _) in enumerate(queries) if truth[i]]
        if not got or np.mean(got) >= recall:
            break
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits


def shards_of(filled: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf, its first shard and over how many it is cut: neighbours share one of up to `most` vectors."""
    first, parts, shard, held = [], [], 0, 0
    for n in filled:
        if held and held + n > most:
            shard, held = shard + 1, 0
        first.append(shard)
        parts.append(max(1, -(-n // most)))
        held += n
        if parts[-1] > 1:
            shard, held = shard + parts[-1], 0
    return np.array(first), np.array(parts)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest inner products found for each query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"), F.coalesce(is_query, F.lit(False)).alias("ask")).filter(F.col("id").isNotNull() & is_usable(F.col("e")))
    sizes = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    size = sizes[0]["n"]
    rows = rows.filter(F.size("e") == size)

    few = F.row_number().over(Window.partitionBy("e").orderBy("id")) <= k + 1  # limited before the shuffle
    index = materialize(packed(rows.select("id", "e").distinct().withColumn("few", few).filter("few").select("id", "e"), size), "points")
    n = index.count()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    share = int(min(1.0, most / n) * (1 << 30))
    sample = index.filter(F.pmod(F.xxhash64(F.lit("tree"), "id"), F.lit(1 << 30)) < share).limit(most).collect()
    sample = sample or index.limit(1).collect()
    x = np.frombuffer(b"".join(r["v"] for r in sorted(sample)), np.float64).reshape(-1, size)
    tree = fit_tree(x, int(min(MOST_LEAVES, max(1, round(3 * n**0.5)))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(as_matrix(batch.column(1), size)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["id", "v", "leaf"])

    points = materialize(index.mapInArrow(send, "id long, v binary, leaf int"), "index")
    asked = rows.filter("ask").select("id", "e").distinct()
    heads = asked.groupBy("e").agg(F.min("id").alias("head"))
    queries = materialize(packed(heads.select("head", "e"), size), "queries")
    asking = queries.count()
    if not asking:
        return empty
    share = int(min(1.0, 2 * CALIBRATION / asking) * (1 << 30))
    trial = sorted((r["id"], bytes(r["v"])) for r in queries.filter(F.pmod(F.xxhash64(F.lit("trial"), "id"), F.lit(1 << 30)) < share).limit(CALIBRATION).collect())
    trial = trial or [(r["id"], bytes(r["v"])) for r in queries.limit(1).collect()]
    visits = widened(tree, trial, brute_force(points, trial, size, k), size, recall)

    filled = Counter({r["leaf"]: r["count"] for r in points.groupBy("leaf").count().collect()})  # one row a leaf
    first, parts = shards_of([filled[leaf] for leaf in range(tree.leaves)], min(SHARD, max(1, SHARD_BYTES // (8 * size)), -(-n // shuffle_partitions(vectors.sparkSession))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ASK_BYTES // (visits * 8 * size))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                own = batch.slice(a, step)
                order = tree.visits(as_matrix(own.column(1), size), visits).reshape(-1)
                per = parts[order]
                of, leaf = np.repeat(np.arange(len(order)) // visits, per), np.repeat(order, per)
                shard = first[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(per) - per, per)
                by = np.lexsort((shard, of))
                of, leaf, shard = of[by], leaf[by].astype(np.int32), shard[by]
                heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (shard[1:] != shard[:-1])]))
                leaves = [leaf[i:j].tobytes() for i, j in zip(heads, np.append(heads[1:], len(leaf)), strict=True)]
                take = pa.array(of[heads], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(shard[heads], pa.int32()), own.column(0).take(take), own.column(1).take(take), pa.array(leaves, pa.binary())], ["shard", "id", "v", "leaves"])

    asks = materialize(queries.mapInArrow(ask, "shard int, id long, v binary, leaves binary"), "asks")
    asked_of = Counter({r["shard"]: r["count"] for r in asks.groupBy("shard").count().collect()})  # one row a shard
    q_parts = F.element_at(F.lit([max(1, -(-asked_of[k] // BLOCK)) for k in range(int((first + parts).max()))]), F.col("shard") + 1)
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    of_leaf = lambda values: F.element_at(F.lit(values.tolist()), F.col("leaf") + 1)
    blocks = points.withColumn("shard", of_leaf(first) + dealt(of_leaf(parts))).withColumn("q_part", F.explode(F.sequence(F.lit(0), q_parts - 1)))
    asks = asks.withColumn("q_part", dealt(q_parts))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("leaf")
            x, q = (np.frombuffer(b"".join(p["v"]), np.float64).reshape(-1, size) for p in (left, right))
            ids, leaf = left["id"].to_numpy(), left["leaf"].to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            ends = np.append(heads[1:], len(leaf))
            for a in range(0, len(q), 128):
                own = right.iloc[a : a + 128]
                wanted = np.frombuffer(b"".join(own["leaves"]), np.int32)
                of = np.repeat(np.arange(len(own)), own["leaves"].str.len().to_numpy() // 4)
                by = np.argsort(wanted, kind="stable")
                wanted, of = wanted[by], of[by]
                scores = np.full((len(own), len(x)), -np.inf)
                for i, j, some in zip(heads, ends, leaf[heads], strict=True):
                    asking = of[np.searchsorted(wanted, some) : np.searchsorted(wanted, some, "right")]
                    scores[asking, i:j] = q[a + asking] @ x[i:j].T
                for row, one, query in zip(scores, q[a : a + 128], own["id"], strict=True):
                    found, exact = best(row, x, one, ids, k + 1)
                    out.append((query, found.tobytes(), exact.tobytes()))
        return pd.DataFrame(out, columns=["q", "ids", "scores"])

    keys = ["shard", "q_part"]
    found = blocks.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(search, "q long, ids binary, scores binary")
    found = found.groupBy("q").agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))  # one a shard, of k + 1 at most

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for lists in batch.column(1).to_pylist():
                i = np.concatenate([np.frombuffer(x["ids"], np.int64) for x in lists])
                s = np.concatenate([np.frombuffer(x["scores"], np.float64) for x in lists])
                order = np.lexsort((i, -s))[: k + 1]
                ids.append(i[order])
                scores.append(s[order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["q", "ids", "scores"])

    merged = found.mapInArrow(merge, "q long, ids array<long>, scores array<double>")
    named = asked.join(heads, "e").select(F.col("id").alias("query_id"), F.col("head").alias("q")).join(merged, "q")
    pairs = F.filter(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score")), lambda p: p["vec_id"] != F.col("query_id"))
    out = named.select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("rank", "p"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "p.vec_id", "p.score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op1_ann": op1_ann}
SQL: dict[str, str] = {}
