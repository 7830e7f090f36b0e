"""Best-fit packing of documents into sequences: length patterns fitted by non-negative least squares.

Only the histogram of piece lengths (at most `capacity` numbers) goes to the driver. There, patterns of up to three
lengths that fill a sequence are listed on a coarse grid, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left over goes, longest first, into the fullest sequence
that still has room, all lengths at once by count. The plan says, for the i-th piece of each length, its sequence
and offset; it has a few thousand rows whatever the number of documents. Pieces get their number within their
length from counts by partition, so no length, however common, meets in one task.

Defined results: null text is the empty text, which is the end token alone; a document longer than a sequence is
cut into full pieces and a rest, others are never cut; repeated rows and repeated or null ids are packed row by
row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import STRETCH, encoder
from .minhash import text_chunks
from .shared import materialize, table, tidy_after

CAPACITY = 4096
END_TOKEN = 1
GRID = 64  # steps of the pattern grid


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        slope = np.where(free, -np.inf, a.T @ (b - a @ x))
        if slope.max(initial=-np.inf) <= scale:
            break
        free[slope.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x += step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
        x = z
    return x


def patterns(grid: int) -> list[tuple[int, ...]]:
    """Up to three grid lengths, longest first, that sum to the grid."""
    out = [(grid,)] + [(grid - b, b) for b in range(1, grid // 2 + 1)]
    return out + [(grid - b - c, b, c) for c in range(1, grid // 3 + 1) for b in range(c, (grid - c) // 2 + 1)]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (number of equal sequences, [(length, pieces of that length in each), ...])."""
    left = {n: c for n, c in histogram.items() if c}
    grid = min(grid, capacity)
    unit = capacity / grid
    cell = lambda n: min(grid, int(np.ceil(n / unit)))
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    by_cell: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        by_cell[cell(n)].append(n)
    kinds = patterns(grid)
    a, b = np.zeros((grid, len(kinds))), np.zeros(grid)
    for j, kind in enumerate(kinds):
        for k in kind:
            a[k - 1, j] += 1
    for k, lengths in by_cell.items():
        b[k - 1] = sum(left[n] for n in lengths)
    weight = np.sqrt(np.arange(1, grid + 1) / grid)  # short pieces fill gaps anyway
    repeats = np.floor(nnls(a * weight[:, None], b * weight)).astype(int) if left else np.zeros(len(kinds), int)

    def take(k: int, most: int) -> tuple[int, int]:
        lengths = by_cell[k]
        while lengths and not left.get(lengths[-1]):
            lengths.pop()
        return (lengths[-1], min(most, left[lengths[-1]])) if lengths else (0, 0)

    for kind, times in sorted(zip(kinds, repeats.tolist(), strict=True), reverse=True):
        while times > 0:
            need = defaultdict(int)
            for k in kind:
                need[k] += 1
            got = {k: take(k, times * m) for k, m in need.items()}
            many = min(got[k][1] // m for k, m in need.items())
            if not many:
                break
            for k, m in need.items():
                left[got[k][0]] -= many * m
            groups.append((many, [(got[k][0], m) for k, m in sorted(need.items(), reverse=True)]))
            times -= many

    # The rest: longest first, each into the fullest sequences with room for it.
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, group: tuple[int, list[tuple[int, int]]]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(group)

    for many, slots in groups:
        put(capacity - sum(n * m for n, m in slots), (many, slots))
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, left[n])
                many = left[n] // each
                put(capacity - each * n, (many, [(n, each)]))
                left[n] -= many * each
                continue
            room = rooms[at]
            many, slots = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // n, left[n])
            used = min(many, left[n] // each)
            if used < many:
                put(room, (many - used, slots))
            put(room - each * n, (used, [*slots, (n, each)]))
            left[n] -= used * each
    return [g for room in rooms for g in open_[room]]


def plan_rows(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Columns: length, first number of that length, first sequence, pieces of it in each sequence, first offset; sorted."""
    rows, used, base = [], defaultdict(int), 0
    for many, slots in plan:
        at = 0
        for n, each in slots:
            rows.append((n, used[n], base, each, at))
            used[n] += many * each
            at += n * each
        base += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_token: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(vocabulary), TaskContext.get().partitionId()
        for batch in batches:
            for row, texts in text_chunks(batch, 1, STRETCH):
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                values, ends = e.packed_texts(texts)
                whole = np.insert(values, ends, end_token).astype("<u4")  # each text with its end
                view, at = memoryview(whole).cast("B"), 0
                for k, end in enumerate((ends + np.arange(1, len(texts) + 1)).tolist(), row):
                    for n, a in enumerate(range(at, end, capacity)):
                        b = min(a + capacity, end)
                        of.append(k)
                        piece.append(n)
                        start.append(a - at)
                        length.append(b - a)
                        crc.append(zlib.crc32(view[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(whole[a:b].astype(np.int32))
                    at = end
                columns = [batch.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(of), pa.int32())]
                names = ["id", "piece", "start", "length", "ids_crc32", "part"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32, sequence_id, offset), and the piece's ids if asked for."""
    pieces = materialize(token_pieces(docs, id_col, text_col, capacity, end_token, vocabulary, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    rows = plan_rows(plan_packing(histogram, capacity))

    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "length", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("part", "length").orderBy("id", "piece", "ids_crc32")) - 1
    numbered = pieces.withColumn("number", number).join(offsets, ["part", "length"]).withColumn("number", F.col("number") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            n, i = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("length", "number"))
            run = rows[np.searchsorted(keys, n << 44 | i, "right") - 1] if len(n) else rows[:0]
            past, each = i - run[:, 1], np.maximum(run[:, 3], 1)
            named = {"sequence_id": pa.array(run[:, 2] + past // each), "offset": pa.array(run[:, 4] + past % each * n)}
            yield pa.RecordBatch.from_arrays([named.get(c.name, None) if c.name in named else batch.column(c.name) for c in out], [c.name for c in out])

    kind = pieces.schema["id"].dataType
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = [f for f in pieces.schema.fields if f.name in names]
    out = sorted(out, key=lambda f: names.index(f.name))
    from pyspark.sql.types import LongType, StructField, StructType

    out = [*out, StructField("sequence_id", LongType()), StructField("offset", LongType())]
    return numbered.select(*names, "number").mapInArrow(place, StructType(out)).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
