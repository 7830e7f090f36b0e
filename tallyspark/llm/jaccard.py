"""Exact similarity join of n-gram sets in a prefix tree.

A text's A-Z are lower-cased and it is cut into words at white space; its set holds the distinct runs of `shingle`
words. Sets are ordered globally, rare n-grams first: by the counter that an n-gram hits in a count sketch of fixed
size (filled from all documents), then by its hash. Any order gives the same links; this one keeps common lines and
passages at the end. Two sets with 100 * intersection >= percent * union share one of the first
n - ceil(percent * n / 100) + 1 members of each, so

1. documents with equal sets are one node from then on;
2. nodes that share such a first n-gram form a bucket, and buckets of the same nodes count once;
3. every node meets the least nodes of a few of its buckets;
4. all nodes of a bucket are held against those of other components by size and bitmap, in blocks of bounded size, and
   components that any such pairs unite form a cluster, so a pair that shares many buckets meets once; the nodes of a
   cluster meet, again in blocks.

In a block the ordered sets of one side make a prefix tree, and each set of the other side goes down it: sets with a
common beginning share the overlap counted so far, and a subtree is left as soon as what remains of both sides cannot
reach the least overlap that its shortest set needs. Pairs whose parity bitmaps differ too much for a link are not
looked up (an n-gram of one set alone flips at most one bit, so this drops no link). A block gives only links
that form a forest, so a large group of near copies costs links in proportion to its size.

Sets are of 64-bit hashes, of which 58 bits take part in the order. No link is left to chance but by equal hashes.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer words
than a shingle has its whole sequence as the one member of its set; rows that repeat are judged one by one, and so
are several texts of one id (the component is named by the least id of the rows whose texts it holds); rows with a
null id get component null and link nothing; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import star_components
from .minhash import BLOCK, FILTER_BITS, by_block, dealt_blocks, id_bitmap, set_digest, shingle_sets, text_chunks
from .shared import drop, materialize, table, tidy_after

SKETCH = 1 << 20  # counters
SLAB = 1 << 12  # counters in a row
BITS = 2048  # of a parity bitmap at least
TRIED = 2  # buckets whose least nodes a node meets before the blocks
WEIGHT = 1024  # members of a set that count as one row of a block


def rarity(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """For each counter of the sketch, the class (two to an octave, 63 at most) of the number of sets that hit it."""

    @tidy_after
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, texts in text_chunks(batch, 0):
                hit = np.concatenate(shingle_sets(texts, shingle)) & np.uint64(SKETCH - 1)
                total += np.bincount(hit.astype(np.int64), minlength=SKETCH)
        yield from slabs({k: total[k * SLAB : (k + 1) * SLAB] for k in range(SKETCH // SLAB)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[slab] = total.get(slab, 0) + np.frombuffer(part.as_buffer(), np.int64)
        yield from slabs(total)

    def slabs(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = {k: v for k, v in total.items() if v.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], ["slab", "counters"])

    kind = "slab int, counters binary"
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, kind).repartition("slab").mapInArrow(add, kind).collect()  # 256 rows of 32 KB
    total = np.zeros(SKETCH, np.int64)
    for slab, part in found:
        total[slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(part, np.int64)
    return np.minimum(np.round(2 * np.log2(np.maximum(total, 1))), 63).astype(np.uint8)


def ordered(members: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set as numbers that sort in the global order."""
    of = classes[(members & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((of << np.uint64(58)) | (members >> np.uint64(6)))


def parity(members: np.ndarray) -> bytes:
    """Bit h modulo the size tells whether oddly many hashes h hit it; the size is a power of two, BITS and the set's size at least."""
    size = max(BITS, 1 << (len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n + percent * -n // 100 + 1


def signatures(docs: DataFrame, classes: np.ndarray, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Rows (id, n, digest, bits, head): size, digest and parity bitmap of each set, and its first members."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_chunks(batch, 1):
                sets = shingle_sets(texts, shingle)
                some = lambda make: [make(s) if len(s) else None for s in sets]  # noqa: E731, B023
                head = some(lambda s: ordered(s, classes)[: prefix_length(len(s), percent)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(map(len, sets), pa.int64()), pa.array(some(set_digest), pa.binary()), pa.array(some(parity), pa.binary()), pa.array(head, pa.list_(pa.int64()))],
                    ["id", "n", "digest", "bits", "head"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n long, digest binary, bits binary, head array<long>")


def buckets(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, node, least): the nodes of each bucket of two and more, one bucket for each set of nodes, and its least node."""
    keys = signed.select("id", "digest", "head").join(nodes.select("id", "digest", "node"), ["id", "digest"]).select("node", F.explode("head").alias("key"))
    often = keys.groupBy("key").count().filter("count > 1").select("key")
    near = materialize(keys.join(often, "key"), "keys")
    one, two = (F.bit_xor(F.xxhash64(F.lit(k), "node")) for k in (1, 2))
    size = near.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), one.alias("one"), two.alias("two"))
    first = size.groupBy("size", "least", "one", "two").agg(F.min("key").alias("key"))
    found = materialize(near.join(first.select("key", "least"), "key").distinct(), "buckets")
    drop(near)
    return found


def with_members(rows: DataFrame, docs: DataFrame, nodes: DataFrame, classes: np.ndarray, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The rows (node, ...) with their nodes' whole sets in the global order, 8 bytes a member."""
    named = rows.join(nodes.select("node", "id", "digest"), "node")
    bitmap = id_bitmap(named.select("id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(0).to_numpy(zero_copy_only=False) % FILTER_BITS
            yield batch.filter(pa.array(bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1))

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_chunks(batch, 0):
                own = batch.slice(at, len(texts))
                sets = shingle_sets(texts, shingle)
                # An id may stand on several texts: the digest tells which of them is meant.
                meant = pa.array([set_digest(s) == d for s, d in zip(sets, own.column(1).to_pylist(), strict=True)], pa.bool_())
                members = pa.array([ordered(s, classes).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[2:], members], [*own.schema.names[2:], "members"]).filter(meant)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    met = source.mapInArrow(some, "id long, text string").join(named, "id").select("text", "digest", *rows.columns)
    return met.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", members binary")


class PrefixTree:
    """Ordered sets with common beginnings stored once; node k has the rows first[k] to last[k] of the sorted sets, and their members from start[k] to end[k]."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.place = np.argsort(self.order)
        self.sets = [sets[i] for i in self.order]
        size = np.array([len(s) for s in self.sets], np.int64)
        common = np.zeros(len(sets), np.int64)
        for k in range(1, len(sets)):
            n = min(size[k - 1], size[k])
            differs = self.sets[k - 1][:n] != self.sets[k][:n]
            common[k] = differs.argmax() if differs.any() else n
        self.first, self.last, self.start, self.end, self.least, self.most, self.children = [], [], [], [], [], [], []
        waiting = [(0, len(sets), 0, -1)] if sets else []
        while waiting:
            first, last, start, parent = waiting.pop()
            inner = common[first + 1 : last]
            end = int(inner.min()) if len(inner) else int(size[first])
            node = len(self.first)
            for column, value in zip((self.first, self.last, self.start, self.end, self.least, self.most, self.children), (first, last, start, end, int(size[first:last].min()), int(size[first:last].max()), []), strict=True):
                column.append(value)
            if parent >= 0:
                self.children[parent].append(node)
            if len(inner):
                cuts = [first, *(np.flatnonzero(inner == end) + first + 1).tolist(), last]
                waiting += [(a, b, end, node) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def search(self, members: np.ndarray, rows: np.ndarray, percent: int) -> Iterator[int]:
        """Of the given rows (numbers of sets), those with 100 * intersection >= percent * union."""
        wanted = np.sort(self.place[rows]).tolist()
        waiting = [(0, 0, 0)]
        while waiting:
            node, overlap, at = waiting.pop()
            first, last = self.first[node], self.last[node]
            k = bisect_left(wanted, first)
            if k == len(wanted) or wanted[k] >= last:
                continue
            edge = self.sets[first][self.start[node] : self.end[node]]
            if len(edge):
                rest = members[at:]
                spots = np.searchsorted(rest, edge)
                inside = spots < len(rest)
                overlap += int((rest[spots[inside]] == edge[inside]).sum())
                at += int(np.searchsorted(rest, edge[-1], "right"))
            left = min(len(members) - at, self.most[node] - self.end[node])
            if (100 + percent) * (overlap + left) < percent * (len(members) + self.least[node]):
                continue
            if last - first == 1:
                yield self.order[first]
            else:
                waiting += [(child, overlap, at) for child in self.children[node]]


class Block:
    """Rows of one block: those on side 0 meet those on side 1, those on side 2 each other."""

    def __init__(self, rows: pa.Table):
        self.node, self.root, self.side, self.n = (rows.column(c).to_numpy() for c in ("node", "root", "side", "n"))
        bits = rows.column("bits").to_pylist()
        self.width = np.array(list(map(len, bits)), np.int64)
        # For each width in use, the bitmaps that are as wide or wider, folded to it, and the places of their rows in it.
        self.folded = {}
        for width in np.unique(self.width).tolist():
            wide = np.flatnonzero(self.width >= width)
            place = np.full(len(bits), -1)
            place[wide] = np.arange(len(wide))
            self.folded[width] = place, np.array([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, width // 8), axis=0) for k in wide])

    def apart(self, u: int, v: np.ndarray) -> np.ndarray:
        """The least number of members that only one of u and each v can have."""
        out = np.zeros(len(v), np.int64)
        widths = np.minimum(self.width[v], self.width[u])
        for width in np.unique(widths).tolist():
            place, bits = self.folded[width]
            own = widths == width
            out[own] = np.bitwise_count(bits[place[v[own]]] ^ bits[place[u]]).sum(axis=1, dtype=np.int64)
        return out

    def partners(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with those rows of other components that its size and bitmap allow to be linked with it."""
        one, two = (np.flatnonzero((self.side == s) | (self.side == 2)) for s in (0, 1))
        for u in one.tolist():
            n = self.n[two]
            may = (self.root[two] != self.root[u]) & (100 * np.minimum(n, self.n[u]) >= percent * np.maximum(n, self.n[u]))
            if self.side[u] == 2:
                may &= (self.side[two] != 2) | (self.node[two] < self.node[u])
            v = two[may]
            v = v[(100 + percent) * self.apart(u, v) <= (100 - percent) * (self.n[v] + self.n[u])]
            if len(v):
                yield u, v

    def clusters(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have partners, and the least of the components that partners unite with each one's own."""
        seen, label = np.zeros(len(self.node), bool), self.root.copy()
        for u, v in self.partners(percent):
            seen[u] = seen[v] = True
            for other in np.unique(label[v]).tolist():
                if other != label[u]:
                    label[label == max(other, label[u])] = min(other, label[u])
        return seen, label

    def forest(self, members: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (u, v) that unite what all links of the block unite: fewer than it has rows."""
        sets = [np.frombuffer(m, np.uint64) for m in members]
        inside = np.flatnonzero(self.side > 0)
        spot = np.full(len(sets), -1)
        spot[inside] = np.arange(len(inside))
        tree = PrefixTree([sets[i] for i in inside])
        label = np.unique(self.root, return_inverse=True)[1]
        links = []
        for u, v in self.partners(percent):
            v = v[label[v] != label[u]]
            for k in tree.search(sets[u], spot[v], percent) if len(v) else ():
                w = int(inside[k])
                if label[w] != label[u]:
                    links.append((self.node[u], self.node[w]))
                    label[label == label[w]] = label[u]
        u, v = zip(*links, strict=True) if links else ((), ())
        return np.array(u, np.int64), np.array(v, np.int64)


BLOCK_ROWS = "g long, side int, node long, root long, n long, bits binary"


def with_bits(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    return blocks.join(nodes.select("node", "n", "bits"), "node").select("g", "side", "node", "root", "n", "bits")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def partnered(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks that may be linked with another one of theirs."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in by_block(batches):
            yield from own.filter(pa.array(Block(own).clusters(percent)[0])).combine_chunks().to_batches()

    return dealt(rows).mapInArrow(run, BLOCK_ROWS)


def clustered(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, node, root): the nodes that may have links to other components, by cluster (key) of components that any such pairs unite."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in by_block(batches):
            block = Block(own)
            seen, mate = block.clusters(percent)
            yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (block.node, block.root, mate)], ["node", "root", "mate"])

    found = materialize(dealt(rows).mapInArrow(run, "node long, root long, mate long"), "partners")
    least = star_components(found.select(F.col("root").alias("u"), F.col("mate").alias("v"))).select(F.col("u").alias("root"), F.col("v").alias("key"))
    return found.select("node", "root").distinct().join(least, "root", "left").select(F.coalesce("key", "root").alias("key"), "node", "root")


def links_in(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that unite all components which a link joins within some block (g, side, node, root, n, bits, members)."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in by_block(batches):
            u, v = Block(own).forest(own.column("members").to_pylist(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return materialize(dealt(rows).mapInArrow(run, "u long, v long"), "links")


def least_blocks(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks (g, side, node, root) in which nodes meet the least nodes of TRIED of their buckets."""
    tries = shared.filter("node != least").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("least")), 1, TRIED).alias("least")).select("node", F.explode("least").alias("least"))
    tries = tries.join(nodes.select("node", F.ceil(F.col("n") / WEIGHT).alias("weight")), "node")
    parts = tries.groupBy("least").agg(F.ceil(F.sum("weight") / BLOCK).alias("parts"))
    g = F.xxhash64("least", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts"))
    met = tries.join(parts, "least").select(g.alias("g"), "node", "least")
    row = lambda side, node: F.struct(F.lit(side).alias("side"), F.col(node).alias("node"), F.col(node).alias("root"))
    heads = met.select("g", "least").distinct().select("g", row(0, "least").alias("r"))
    return met.select("g", row(1, "node").alias("r")).unionByName(heads).select("g", "r.*")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id_col, n_shingles, component_id): the size of each document's set and the least id that links reach from it.

    Links are pairs with 100 * intersection >= percent * union, percent from 1 to 100.
    """
    classes = rarity(docs, text_col, shingle)
    signed = materialize(signatures(docs, classes, id_col, text_col, shingle, percent), "signatures")
    nodes = signed.filter("id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "bits")).alias("s")).select("digest", "s.*")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    shared = buckets(signed, nodes)
    whole = lambda rows: with_members(rows, docs, nodes, classes, id_col, text_col, shingle)

    some = materialize(partnered(with_bits(least_blocks(shared, nodes), nodes), percent), "blocks")
    first = links_in(whole(some), percent)
    stars = star_components(first)
    drop(some)

    root = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    weighed = nodes.select("node", F.ceil(F.col("n") / WEIGHT).alias("weight"))
    labelled = shared.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = clustered(with_bits(dealt_blocks(labelled).select("g", "side", "node", "root"), nodes), percent)
    some = materialize(with_bits(dealt_blocks(apart.join(weighed, "node"), F.col("weight")).select("g", "side", "node", "root"), nodes), "blocks")
    links = links_in(whole(some), percent)
    drop(some)
    after = star_components(stars.unionByName(links))
    for old in (first, stars, links, shared):
        drop(old)

    ids = nodes.select("digest", "id", "node").join(after.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    out = signed.select("id", "n", "digest").join(ids.join(least, "root").select("digest", "component_id"), "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""

QUERIES = {"op13_jaccard_join": op13_jaccard_join}
SQL = {"op13_jaccard_join": ORACLE}
