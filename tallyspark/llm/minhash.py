"""Near-duplicate documents: many universal hash minima, banding, verification, and connected components.

A text's A-Z are lower-cased and it is cut into words at white space; its set holds the distinct runs of
`shingle` words. Of each set, 256 minima under universal hash functions are taken; 32 bands of 4 make bucket keys
(two sets of similarity 0.8 miss all of them once in 2e7). Documents with equal sets are one node from then on, so
groups of copies cost nothing further.

Links are sought in three passes, each followed by components by alternating large-star and small-star, and each
looking only at pairs whose ends are still in different components:
1. every document against the least document of one of its buckets,
2. every document against the least documents of its first eight buckets,
3. the pairs that share a bucket across components, compared in blocks of bounded size inside the tasks: first on
   minima, then those documents that have a likely partner once more, with their full sets. Only links that form a
   forest leave a block, fewer than it has documents.
So a large group of near copies costs links in proportion to its size. Pairs whose minima agree too seldom (less
than 0.68, nearly five standard deviations below 0.8) are dropped; all others are confirmed on their full sets.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer
words than a shingle has its whole sequence as the one member of its set; repeated rows are judged row by row, and so
are several texts of one id (a text's component is named by the least id of the rows whose texts it holds); rows
with a null id get component null and are kept; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import star_components
from .shared import drop, materialize, table, tidy_after

BANDS, ROWS = 32, 4
MINIMA = 256  # all of them serve the estimate, the first BANDS * ROWS the buckets
LEAST_ESTIMATE = 0.68
FILTER_BITS = 1 << 23
TRIED_BANDS = 8  # whose heads a document is held against before the exact pass
BLOCK = 2048  # members of a bucket that are compared at a time

_seed = np.random.default_rng(20240501)
_BYTE = _seed.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_A = _seed.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None] | np.uint32(1)
_B = _seed.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
CHUNK = 1 << 18  # bytes of text that a task works on at a time


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            all_ = np.full(n, base, np.uint64)
            all_[0] = 1
            _POWERS[name] = np.multiply.accumulate(all_)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not len(joined):
        return []
    gap = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(joined) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[joined] * up[:-1])])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, bounds)
    rolled = words
    if len(words) >= shingle:
        rolled = words[: len(words) - shingle + 1]
        for k in range(1, shingle):
            rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - shingle + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b > a:
            one = words[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one * np.uint64(0xD6E8FEB86659FD93) + words[k : k + 1])
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def set_digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def minima(members: np.ndarray) -> np.ndarray:
    x = (members >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (x[None, k : k + 4096] * _A + _B).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return keys.view(np.int64)


def text_chunks(batch: pa.RecordBatch, column: int, chunk: int = CHUNK, read: Callable[[bytes], bytes] = bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of stretches of about `chunk` bytes; null counts as empty. read: gives the text of what is in the column."""
    at, size, own = 0, 0, []
    for row, value in enumerate(batch.column(column).cast(pa.binary())):
        text = read(value.as_py() or b"")
        if own and size + len(text) > chunk:
            yield at, own
            at, size, own = row, 0, []
        own.append(text)
        size += len(text)
    if own:
        yield at, own


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, h, n, digest, bands, least): size and digest of each set, bucket keys, and the minima's low bytes."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_chunks(batch, 2):
                n, digest, bands, low = [], [], [], []
                for members in shingle_sets(texts, shingle):
                    n.append(len(members))
                    if len(members):
                        least = minima(members)
                        digest.append(set_digest(members))
                        bands.append(band_keys(least[: BANDS * ROWS]))
                        low.append(least.astype(np.uint8).tobytes())
                    else:
                        digest.append(None)
                        bands.append(None)
                        low.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                    ["id", "h", "n", "digest", "bands", "least"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, h long, n long, digest binary, bands array<long>, least binary")


def id_bitmap(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size with the bit of every id (modulo its size) set; it may let others through, never fewer."""
    spot = ids.select(F.pmod("id", F.lit(bits)).alias("spot"))
    rows = spot.select(F.expr("bitmap_bucket_number(spot)").alias("b"), F.expr("bitmap_bit_position(spot)").alias("p"))
    found = rows.groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("m")).collect()  # bits / 32768 rows of 4 KB
    out = np.zeros(bits + 65536, bool)
    for b, m in found:
        # Bucket b covers (b - 1) * 32768 + 1 to b * 32768; bucket 0 is spot 0.
        own = np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little"))
        out[(own + (b - 1) * 32768 + 1) if b else own] = True
    return np.packbits(out[:bits], bitorder="little")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (node, members) for the wanted nodes: their whole shingle sets, 8 bytes a member."""
    named = nodes.select("node", "id", "digest").join(wanted, "node", "left_semi")
    bitmap = id_bitmap(named.select("id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(0).to_numpy(zero_copy_only=False) % FILTER_BITS
            yield batch.filter(pa.array(bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1))

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_chunks(batch, 1):
                sets = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(map(set_digest, sets), pa.binary()), pa.array([m.tobytes() for m in sets], pa.binary())], ["digest", "members"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    near = source.mapInArrow(some, "id long, text string").join(named.select("id").distinct(), "id", "left_semi")
    # An id may stand on several texts: the digest tells which of them is meant.
    return near.mapInArrow(run, "digest binary, members binary").dropDuplicates(["digest"]).join(named.select("digest", "node"), "digest").select("node", "members")


def estimates(low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Similarity as the minima's low bytes tell it; a byte in 256 agrees by chance."""
    return ((low[u] == low[v]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and minima allow a link."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join([*batch.column(2).to_pylist(), *batch.column(3).to_pylist()]), np.uint8).reshape(2 * batch.num_rows, -1)
            at = np.arange(batch.num_rows)
            yield batch.select([0, 1]).filter(pa.array(estimates(low, at, at + batch.num_rows) >= LEAST_ESTIMATE))

    left = nodes.select(F.col("node").alias("u"), F.col("least").alias("x"), F.col("n").alias("nu"))
    right = nodes.select(F.col("node").alias("v"), F.col("least").alias("y"), F.col("n").alias("nv"))
    both = pairs.join(left, "u").join(right, "v").filter("100 * least(nu, nv) >= 80 * greatest(nu, nv)")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union on their full sets."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                shared = int((b[at] == a).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("members").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


class Block:
    """Rows of one block of a bucket: those on side 0 meet those on side 1, those on side 2 each other."""

    def __init__(self, rows: pa.Table):
        column = lambda name: rows.column(name).to_numpy()
        self.node, self.root, self.side, self.n, self.key = (column(c) for c in ("node", "root", "side", "n", "key"))
        self.low = np.frombuffer(b"".join(rows.column("least").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.bands = np.concatenate([c.flatten().to_numpy() for c in rows.column("bands").chunks]).reshape(len(self.node), -1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs across components that may be links and meet in no earlier band, so many at a time."""
        one, two = (np.flatnonzero((self.side == s) | (self.side == 2)) for s in (0, 1))
        for k in range(0, len(one), 512):
            own = one[k : k + 512]
            n, m = self.n[own][:, None], self.n[two][None, :]
            may = (self.root[own][:, None] != self.root[two][None, :]) & (100 * np.minimum(n, m) >= 80 * np.maximum(n, m))
            may &= (self.side[own][:, None] < 2) | (self.node[own][:, None] > self.node[two][None, :])
            x, y = np.nonzero(may)
            for a in range(0, len(x), 1 << 15):
                u, v = own[x[a : a + (1 << 15)]], two[y[a : a + (1 << 15)]]
                near = estimates(self.low, u, v) >= LEAST_ESTIMATE
                u, v = u[near], v[near]
                once = self.bands[u, (self.bands[u] == self.bands[v]).argmax(axis=1)] == self.key[u]
                if once.any():
                    yield u[once], v[once]

    def with_partners(self) -> np.ndarray:
        out = np.zeros(len(self.node), bool)
        for u, v in self.pairs():
            out[u] = out[v] = True
        return out

    def forest(self, members: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (u, v) that unite what all confirmed pairs of the block unite: fewer than it has rows."""
        sets = [np.frombuffer(m, np.uint64) for m in members]
        of = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        values, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(many > 1) - 1  # only members of two sets can be common
        keep = (many > 1)[code]
        of, code = of[keep], shared[code[keep]]
        order = np.argsort(code, kind="stable")
        of, code = of[order], code[order]
        width = 1 << 13
        cuts = np.searchsorted(code, np.arange(0, int(code[-1]) + width + 1, width)) if len(code) else [0]
        slabs = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            bits = np.zeros((len(sets), width), bool)
            bits[of[a:b], code[a:b] - k * width] = True
            slabs.append(np.packbits(bits, axis=1).view(np.uint64))
        label = np.arange(len(sets))
        for u, v in self.pairs():
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
            common = np.zeros(len(u), np.int64)
            for slab in slabs:
                for a in range(0, len(u), 4096):
                    common[a : a + 4096] += np.bitwise_count(slab[u[a : a + 4096]] & slab[v[a : a + 4096]]).sum(axis=1, dtype=np.int64)
            links = 100 * common >= percent * (self.n[u] + self.n[v] - common)
            u, v = u[links], v[links]
            while len(u):
                a, b = label[u], label[v]
                u, v, a, b = (x[a != b] for x in (u, v, a, b))
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        own = np.flatnonzero(label != np.arange(len(label)))
        return self.node[own], self.node[label[own]]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; batches are sorted by g, and a block may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[-1].as_py() != g[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def dealt_blocks(labelled: DataFrame, weight: Column | None = None) -> DataFrame:
    """Rows (g, side, key, node, root): the members (key, node, root, ...) of buckets that hold several components (root), by block.

    A component with more than BLOCK members in a bucket has blocks of its own, which meet those of other components
    only; all small ones share blocks that meet each other too. So members of one large component, however many,
    are sent once for each block of others. A member counts `weight` times, once if there is none.
    """
    size = labelled.groupBy("key", "root").agg((F.count("*") if weight is None else F.sum(weight)).alias("count"))
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    large = F.when(F.col("count") > BLOCK, F.struct("root", parts.alias("parts")))
    small = F.sum(F.when(F.col("count") <= BLOCK, F.col("count")).otherwise(0))
    mixed = size.groupBy("key").agg(F.count("*").alias("roots"), F.array_compact(F.collect_list(large)).alias("large"), F.ceil(small / BLOCK).cast("int").alias("rest")).filter("roots > 1")
    rows = labelled.join(mixed, "key")
    rows = rows.withColumn("own_parts", F.try_element_at(F.transform(F.filter("large", lambda b: b["root"] == F.col("root")), lambda b: b["parts"]), F.lit(1)))
    block = lambda root, part: F.struct(root.cast("long").alias("root"), part.cast("int").alias("part"))
    spread = F.xxhash64(F.lit("block"), "node")
    rows = rows.withColumn("own", F.when(F.col("own_parts").isNotNull(), block(F.col("root"), F.pmod(spread, "own_parts"))).otherwise(block(F.lit(-1), F.pmod(spread, F.greatest("rest", F.lit(1))))))
    upto = lambda n: F.slice(F.sequence(F.lit(0), n), 1, n)
    all_ = F.concat(F.flatten(F.transform("large", lambda b: F.transform(upto(b["parts"]), lambda p: block(b["root"], p)))), F.transform(upto(F.col("rest")), lambda p: block(F.lit(-1), p)))
    met = rows.withColumn("other", F.explode(F.filter(all_, lambda o: (o["root"] < 0) | (o["root"] != F.col("own.root")))))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), side.alias("side"), "key", "node", "root")


def blocks_of(labelled: DataFrame, sketch: DataFrame) -> DataFrame:
    """Rows (g, side, key, node, root, n, least, bands): the members of each block with what is compared first."""
    return dealt_blocks(labelled).join(sketch, "node").select("g", "side", "key", "node", "root", "n", "least", "bands")


BLOCK_ROWS = "g long, side int, key long, node long, root long, n long, least binary, bands array<long>"


def links_across(docs: DataFrame, nodes: DataFrame, labelled: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) that unite all components which a link joins within some bucket; fewer than rows of blocks."""
    sketch = nodes.select("node", "n", "least", "bands")

    @tidy_after
    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_block(batches):
            yield from rows.filter(pa.array(Block(rows).with_partners())).combine_chunks().to_batches()

    @tidy_after
    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_block(batches):
            u, v = Block(rows).forest(rows.column("members").to_pylist(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = lambda rows: rows.repartition("g").sortWithinPartitions("g")
    some = materialize(dealt(blocks_of(labelled, sketch)).mapInArrow(partnered, BLOCK_ROWS), "blocks")
    sets = full_sets(docs, nodes, some.select("node").distinct(), id_col, text_col, shingle)
    whole = some.join(sets, "node").select("g", "side", "key", "node", "root", "n", "least", "bands", "members")
    links = materialize(dealt(whole).mapInArrow(united, "u long, v long"), "links")
    drop(some)
    return links


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, h, n_shingles, component_id, kept), h being the xxhash64 of the text (null: null)."""
    signed = materialize(signatures(docs, id_col, text_col, shingle), "signatures")
    nodes = signed.filter("id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "bands", "least")).alias("s")).select("digest", "s.*")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1").select("key", "head")
    shared = materialize(keys.join(heads, "key").select("key", "head", "node", "band"), "buckets")
    sketch = nodes.select("node", "n", "least")
    sets_of = lambda pairs: full_sets(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), id_col, text_col, shingle)

    tries = shared.filter("node != head").select(F.col("node").alias("u"), F.col("head").alias("v"), "band")
    first = materialize(estimated(tries.groupBy("u").agg(F.min("v").alias("v")), sketch), "tries")
    stars = star_components(confirmed(first, sets_of(first), percent))
    root = lambda side: stars.select(F.col("u").alias(side), F.col("v").alias(f"root_{side}"))

    some = tries.filter(F.col("band") < TRIED_BANDS).select("u", "v").distinct()
    named = some.join(first, ["u", "v"], "left_anti").join(root("u"), "u", "left").join(root("v"), "v", "left")
    more = materialize(estimated(named.filter("coalesce(root_u, u) != coalesce(root_v, v)").select("u", "v"), sketch), "tries")
    wider = star_components(stars.unionByName(confirmed(more, sets_of(more), percent)))
    for old in (first, more, stars):
        drop(old)
    stars = wider

    labelled = shared.select("key", "node").join(root("node"), "node", "left").select("key", "node", F.coalesce("root_node", "node").alias("root"))
    links = links_across(docs, nodes, labelled, id_col, text_col, shingle, percent)
    after = star_components(stars.unionByName(links))
    for old in (links, shared, stars):
        drop(old)

    ids = nodes.select("digest", "id", "node").join(after.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    out = signed.select("id", "h", "n", "digest").join(ids.join(least, "root").select("digest", "component_id"), "digest", "left")
    out = out.select("id", "h", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept); one document of each component is kept, the one of least id.

    The bands are laid out for a percent of 80 or more.
    """
    return judged(docs, id_col, text_col, shingle, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept. Rows go one by one: another text of the same id stays if it is kept itself."""
    gone = judged(docs, id_col, text_col, shingle, percent).filter(~F.col("kept")).select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    same = (F.col(f"`{id_col}`").cast("long") == F.col("_id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_h"))
    return docs.join(gone, same, "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""

QUERIES = {"op5_minhash": op5_minhash}
SQL = {"op5_minhash": ORACLE}
