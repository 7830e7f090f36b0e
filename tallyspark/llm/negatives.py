"""Hard negatives: of each anchor's nearest rows of its own label, the nearest rows of other labels just below them.

Vectors become whole numbers, floor(SCALE * x), and scores are their inner products, exact in 64-bit arithmetic. They are
computed in tiles of anchors by candidates by Strassen's recursion: a tile is padded with zeros to halves of like
size, seven products of halves replace eight, and additions of whole numbers lose nothing; small halves are multiplied
plainly. Two passes go over all candidates. The first keeps a heap of each anchor's best rows of its label
(positives), the second a heap for each anchor and positive of the best rows of other labels whose score lies in the
positive's window. Heaps have a fixed size and are merged by score and id, within a task and then across tasks.

Anchors are a stated part of the rows and meet all rows in blocks: groups of at most GROUP_BYTES stand in a task while
the candidates of its cell stream through, so a candidate is sent once for each group of anchors. In the first
pass groups hold anchors of one label and meet candidates of that label only. Candidates are spread over cells by a hash, so
neither a label nor a group makes a large task.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do
those with a component beyond 2^54, which has no place in a score; of rows with one id the least (by label, then vector) counts;
vectors of different lengths are compared as if the shorter one went on in zeros; a row is never its own partner; ties
go to the smaller id; anchors without positives and positives without negatives give no rows; an empty table gives an
empty result. Scores beyond 64 bits wrap. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, shuffle_partitions, table, tidy_after

SCALE = 256.0
GROUP_BYTES = 1 << 24  # of a group of anchors as 64-bit numbers
CELL_ROWS = 1 << 18  # candidates of a cell, about
TILE = 2048  # candidates multiplied at a time
PLAIN = 24  # halves no larger than this in some direction are multiplied plainly
LARGEST = float(1 << 54)
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 64-bit whole numbers."""
    (m, k), n = a.shape, len(b)
    if min(m, k, n) <= PLAIN:
        return a @ b.T
    halves = lambda x: np.pad(x, [(0, s % 2) for s in x.shape])
    quarters = lambda x: (x[: x.shape[0] // 2, : x.shape[1] // 2], x[: x.shape[0] // 2, x.shape[1] // 2 :], x[x.shape[0] // 2 :, : x.shape[1] // 2], x[x.shape[0] // 2 :, x.shape[1] // 2 :])
    a11, a12, a21, a22 = quarters(halves(a))
    b11, b21, b12, b22 = quarters(halves(b))  # of the transposed b
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * len(p1), 2 * p1.shape[1]), np.int64)
    h, w = p1.shape
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Whole numbers of a list column, one row each, ended with zeros."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


class Heaps:
    """The best `most` (score, id) of each slot."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot = np.empty(0, np.int64)
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.worst = np.full(slots, NONE)  # what a full heap's last has

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, slot))
        slot = slot[order]
        at = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = at < self.most
        self.slot, self.score, self.id = slot[keep], score[order[keep]], ids[order[keep]]
        full = at[keep] == self.most - 1
        self.worst[self.slot[full]] = self.score[full]


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, vector) that take part, one for each id."""
    small = lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False))
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    some = some.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", small))
    return some.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")


def in_cells(anchors: DataFrame, rows: DataFrame, groups: DataFrame, cells: int) -> DataFrame:
    """Rows (cell, side, id, label, vector, grp, windows): each group of anchors (side 0) once in each of its cells, before candidates (side 1).

    anchors: id, label, vector, grp, windows. groups: grp, label; candidates meet the groups of their label, or all if
    it is null. Each group has `cells` cells.
    """
    cell = lambda part: F.xxhash64("grp", part.cast("long")).alias("cell")
    one = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).select(cell(F.col("part")), F.lit(0).alias("side"), "id", "label", "vector", "windows")
    own = groups.filter("label is not null")
    met = rows.join(own.withColumnRenamed("label", "_label"), F.col("label") == F.col("_label")).drop("_label")
    every = [r[0] for r in groups.filter("label is null").collect()]  # one a GROUP_BYTES of anchors
    if every:
        met = rows.withColumn("grp", F.explode(F.array(*[F.lit(g).cast("long") for g in every])))
    two = met.select(cell(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(cells))), F.lit(1).alias("side"), "id", "label", "vector", F.lit(None).cast("array<struct<positive:long,score:long>>").alias("windows"))
    return one.unionByName(two).repartition("cell").sortWithinPartitions("cell", "side")


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch | None]]:
    """(anchors, candidates) of each cell, so many candidates at a time; None tells that the cell ends."""
    cell, held, anchors = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if key[a] != cell:
                if anchors is not None:
                    yield anchors, None
                cell, held, anchors = key[a], [], None
            if side[a] == 0:
                held.append(batch.slice(a, b - a))
                continue
            if anchors is None and held:
                anchors = pa.Table.from_batches(held).combine_chunks()
            if anchors is not None:
                for k in range(a, b, TILE):
                    yield anchors, batch.slice(k, min(TILE, b - k))
    if anchors is not None:
        yield anchors, None


def best_of_cells(dealt: DataFrame, most: int, slots_of: Callable, wanted: Callable) -> DataFrame:
    """Rows (anchor, positive, positive_score, score, id): the best of each slot in each cell.

    slots_of(anchors): (row of the anchor, positive, positive's score) of each slot. wanted(scores, own labels,
    labels, slots, worst): which (slot, candidate) may enter.
    """

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for anchors, rows in tiles(batches):
            if state is None:
                first, column = anchors.to_batches()[0], lambda name: anchors.column(name).to_numpy()  # noqa: B023
                slots = slots_of(anchors)
                state = matrix(first.column("vector")), column("id"), column("label"), slots, Heaps(len(slots[0]), most)
            a, ids, labels, slots, heaps = state
            if rows is None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[slots[0][heaps.slot]], slots[1][heaps.slot], slots[2][heaps.slot], heaps.score, heaps.id)], ["anchor", "positive", "positive_score", "score", "id"])
                state = None
                continue
            b, others, own = matrix(rows.column("vector")), rows.column("id").to_numpy(), rows.column("label").to_numpy()
            width = min(a.shape[1], b.shape[1])
            scores = strassen(a[:, :width], b[:, :width])
            for k in range(0, len(slots[0]), 512):
                part = slice(k, k + 512)
                at = slots[0][part]
                s = scores[at]
                may = wanted(s, labels[at][:, None] == own[None, :], slots[2][part][:, None]) & (s >= heaps.worst[part][:, None]) & (ids[at][:, None] != others[None, :])
                x, y = np.nonzero(may)
                if len(x):
                    heaps.add(x + k, s[x, y], others[y])

    return dealt.mapInArrow(run, "anchor long, positive long, positive_score long, score long, id long")


def merged(found: DataFrame, most: int) -> DataFrame:
    """The best of the cells' heaps of each (anchor, positive), with rank."""
    w = Window.partitionBy("anchor", "positive", "positive_score").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on `id`. A negative's score lies from percent / 100 of its positive's score to all of it.
    """
    spark = rows.sparkSession
    some = materialize(usable(rows, id_col, vector_col, label_col), "vectors")
    asked = some.filter(is_anchor)
    size = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    total = some.count()
    per_group = max(1, GROUP_BYTES // (8 * max(1, size[1] or 0)))
    spread = lambda n: F.pmod(F.xxhash64(F.lit("group"), "id"), n)
    partitions = shuffle_partitions(spark)
    none = F.lit(None).cast("array<struct<positive:long,score:long>>")

    many = asked.groupBy("label").agg(F.ceil(F.count("*") / per_group).alias("parts"))
    first = asked.join(many, "label").withColumn("grp", F.xxhash64("label", spread(F.col("parts")))).withColumn("windows", none).drop("parts")
    groups = many.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), "label").select(F.xxhash64("label", "k").alias("grp"), "label")
    cells = max(1, partitions // 4, -(-total // CELL_ROWS))
    same = lambda anchors: (np.arange(anchors.num_rows), np.zeros(anchors.num_rows, np.int64), np.zeros(anchors.num_rows, np.int64))
    best = best_of_cells(in_cells(first, some, groups, cells), positives, same, lambda s, like, _: like)
    chosen = merged(best, positives).groupBy("anchor").agg(F.collect_list(F.struct(F.col("id").alias("positive"), "score")).alias("windows"))
    chosen = materialize(chosen, "positives")

    parts = max(1, -(-size[0] // per_group))
    second = asked.join(chosen.withColumnRenamed("anchor", "id"), "id").withColumn("grp", spread(F.lit(parts)).cast("long"))
    groups = spark.range(parts).select(F.col("id").alias("grp"), F.lit(None).cast("long").alias("label"))
    cells = max(1, -(-2 * partitions // parts), -(-total // CELL_ROWS))

    def windows(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = anchors.column("windows").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        each = lists.flatten()
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), each.field("positive").to_numpy(), each.field("score").to_numpy()

    def inside(s: np.ndarray, like: np.ndarray, top: np.ndarray) -> np.ndarray:
        least = -(-percent * top // 100)
        return ~like & (s <= top) & (s >= least)

    found = merged(best_of_cells(in_cells(second, some, groups, cells), negatives, windows, inside), negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), "id % 100 = 0")


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {"op11_hard_negatives": ORACLE}
