"""Batches under several limits: lines that need the same documents together, connected lines, pages of long documents.

Packing is sequential, so rows are cut into short segments first. Which rows begin a segment is told by a hash of the
row alone: neither the size of the table nor its partitions move the others' borders, and each segment is packed
in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cut import checkpointed, growing
from .reviews import global_number

BATCH_LINES, PROMPT_CHARS = 20, 180_000
REQUEST_IMAGES, REQUEST_CHARS = 40, 100_000
SEGMENT = 64  # rows of a segment, on average
MINIMA = 3


def begins(key: Column) -> Column:
    """One in SEGMENT rows, by its key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("bigint") % SEGMENT == 0


def segments(rows: DataFrame, order: list[str], starts: Column, name: Column) -> DataFrame:
    """Adds `segment`: the name of the last row, at or before each one in the given order, for which `starts` holds; "" before the first."""
    dealt = checkpointed(rows.withColumn("_name", F.when(starts, name.cast("string"))).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    ends = dealt.groupBy("_part").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("_id"))).alias("_end"))  # one row a range
    before = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    own = F.last("_name", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = dealt.withColumn("_own", own).join(ends.select("_part", before.alias("_before")), "_part")
    return found.withColumn("segment", F.coalesce("_own", "_before", F.lit(""))).drop("_name", "_id", "_part", "_own", "_before")


def each_segment(rows: DataFrame, order: str, work: Callable[[list[tuple]], list], kind: str) -> DataFrame:
    """Rows (name, value): from rows (segment, name, ...), what `work` gives for each row of a segment, these in the order of a column.

    Segments are short and many, so they stream through the tasks one after the other; tasks are as many as shuffles have, however few bytes there are.
    """
    names = rows.columns
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kept: list = []  # (name, value)
        own = None
        for batch in batches:
            own = batch.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    kept += zip((r[1] for r in held), work(held), strict=True)
                    held = []
                held.append(row)
            yield from out(kept, own)
            kept = []
        if held:
            yield from out(list(zip((r[1] for r in held), work(held), strict=True)), own)

    def out(kept: list, own: pa.DataType) -> Iterator[pa.RecordBatch]:
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], own), pa.array([v for _, v in kept], pa.string())], [names[1], kind])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "segment").sortWithinPartitions("segment", order).mapInArrow(run, f"{names[1]} {kinds[names[1]]}, {kind} string")


def fitting(chars: int, documents: dict, more_chars: int, more: dict) -> int:
    """Characters of a batch with more lines; each document counts once."""
    return chars + more_chars + sum(documents.values()) + sum(c for d, c in more.items() if d not in documents)


def packed(units: list[tuple], size: int, limit: int) -> list[list[int]]:
    """Batches of units (first line, lines, chars, {document: chars}): the largest unit left, then again and again the unit that
    fits with most documents in common, fewest new ones and the earliest line."""
    left = sorted(range(len(units)), key=lambda i: (-units[i][1], units[i][0]))
    out = []
    while left:
        batch = [left.pop(0)]
        _, lines, chars, documents = units[batch[0]]
        documents = dict(documents)
        while True:
            able = [i for i in left if lines + units[i][1] <= size and fitting(chars, documents, units[i][2], units[i][3]) <= limit]
            if not able:
                break
            shared = {i: len(documents.keys() & units[i][3].keys()) for i in able}
            i = min(able, key=lambda i: (-shared[i], len(units[i][3]) - shared[i], units[i][0]))  # noqa: B023
            left.remove(i)
            batch.append(i)
            lines, chars, documents = lines + units[i][1], chars + units[i][2], documents | units[i][3]
        out.append(batch)
    return out


def affine_batches(lines: DataFrame, wanted: DataFrame, documents: DataFrame, size: int = BATCH_LINES, limit: int = PROMPT_CHARS) -> DataFrame:
    """Rows (bank_id, component, batch): competing lines together, and beside them lines that need the same documents.

    lines: bank_id, component, best (candidate), chars. wanted: bank_id, document. documents: document, chars. A batch has at most
    `size` lines, and with each of its documents once at most `limit` characters. A component beyond that is cut by best
    candidate and then into consecutive chunks. Components and chunks are sorted by the least hashes of their documents,
    so those with documents in common are neighbours; segments of neighbours are packed greedily. A single line over the limit is a batch of its own.
    """
    lines = checkpointed(lines.select("bank_id", "component", "best", "chars"))  # what several steps read is written once
    needed = checkpointed(wanted.select("bank_id", "document").distinct().join(documents.select("document", F.col("chars").alias("doc_chars")), "document"))
    of = lambda key: needed.join(growing(lines.select("bank_id", key)), "bank_id").select(key, "document", "doc_chars").distinct()
    extent = lines.groupBy("component").agg(F.count("*").alias("n"), F.sum("chars").alias("own"))
    extent = extent.join(growing(of("component").groupBy("component").agg(F.sum("doc_chars").alias("docs"))), "component", "left")
    whole = extent.select("component", ((F.col("n") <= size) & (F.col("own") + F.coalesce("docs", F.lit(0)) <= limit)).alias("whole"))
    named = checkpointed(lines.join(growing(whole), "component"))
    as_docs = F.collect_list(F.struct(F.col("document").cast("string").alias("document"), F.col("doc_chars").cast("long").alias("chars"))).alias("docs")  # of a line or of a unit: few

    large = named.filter(~F.col("whole"))
    first = large.groupBy("component", "best").agg(F.min("bank_id").alias("first"))
    rows = large.join(growing(first), ["component", "best"]).join(growing(needed.groupBy("bank_id").agg(as_docs)), "bank_id", "left")
    rows = segments(rows, ["component", "best", "bank_id"], (F.col("bank_id") == F.col("first")) | begins(F.col("bank_id")), F.concat_ws("/", "component", "bank_id"))

    def cut(own: list[tuple]) -> list[str]:
        k, n, chars, held, found = -1, size, 0, {}, []
        for segment, _, more_chars, docs in own:
            more = {d["document"]: d["chars"] for d in docs or []}
            if n >= size or fitting(chars, held, more_chars, more) > limit:
                k, n, chars, held = k + 1, 0, 0, {}
            n, chars, held = n + 1, chars + more_chars, held | more
            found.append(f"{segment}/{k}")
        return found

    cuts = each_segment(rows.select("segment", "bank_id", "chars", "docs"), "bank_id", cut, "unit")
    units_of = checkpointed(named.filter("whole").select("bank_id", F.col("component").cast("string").alias("unit")).unionByName(cuts))

    placed = lines.join(growing(units_of), "bank_id")
    least = [F.min(F.xxhash64(F.lit(k), "document")).alias(f"least{k}") for k in range(MINIMA)]
    docs = needed.join(growing(units_of), "bank_id").select("unit", "document", "doc_chars").distinct().groupBy("unit").agg(as_docs, *least)
    units = placed.groupBy("unit").agg(F.min("bank_id").alias("first"), F.count("*").alias("n"), F.sum("chars").alias("chars")).join(growing(docs), "unit", "left")
    units = segments(units, [*(f"least{k}" for k in range(MINIMA)), "first"], begins(F.col("first")), F.col("first"))

    def pack(own: list[tuple]) -> list[str]:
        each = [(first, n, chars, {d["document"]: d["chars"] for d in docs or []}) for _, _, first, n, chars, docs in own]
        found = {i: k for k, batch in enumerate(packed(each, size, limit)) for i in batch}
        return [f"{u[0]}-{found[i]}" for i, u in enumerate(own)]

    batches = each_segment(units.select("segment", "unit", "first", "n", "chars", "docs"), "first", pack, "batch")
    return placed.join(growing(batches), "unit").select("bank_id", "component", "batch")


def connected_batches(lines: DataFrame, size: int) -> DataFrame:
    """Rows (bank_id, component, batch): whole components in their order, the next one in the same batch if it fits.

    Components of more than `size` lines have batches of their own, each of `size` consecutive lines. Every segment of
    components begins a new batch.
    """
    extent = lines.groupBy("component").agg(F.count("*").alias("n"))
    small = segments(extent.filter(F.col("n") <= size), ["component"], begins(F.col("component")), F.col("component"))

    def fit(own: list[tuple]) -> list[str]:
        k, used, found = 0, 0, []
        for segment, _, n in own:
            if used + n > size:
                k, used = k + 1, 0
            used += n
            found.append(f"{segment}-{k}")
        return found

    fitted = each_segment(small.select("segment", "component", "n"), "component", fit, "batch")
    large = lines.join(growing(extent.filter(F.col("n") > size).select("component")), "component", "left_semi").select("bank_id", "component", F.struct("component", "bank_id").alias("place"))
    numbered = global_number(large, "place", "number")  # a component may hold a third of the lines, so none is numbered alone
    start = numbered.groupBy("component").agg(F.min("number").alias("start"))
    sliced = numbered.join(growing(start), "component").select("bank_id", "component", F.concat_ws("/", "component", F.floor((F.col("number") - F.col("start")) / size)).alias("batch"))
    return lines.join(growing(fitted), "component").select("bank_id", "component", "batch").unionByName(sliced)


def bounded_requests(units: DataFrame, pages: int = 20, images: int = REQUEST_IMAGES, chars: int = REQUEST_CHARS, overhead: int = 0) -> DataFrame:
    """Rows (document, page, request): consecutive pages of a document share a request up to all three limits.

    units: document, page, chars, images, blocked; the units of a page stay together. A page beyond a limit by itself, or with a blocked unit, has no
    request (null), and no request goes on across it. Each request has `overhead` characters besides. The state that is
    carried along the sorted pages is three counters, so a long document streams through its task.
    """
    page = units.groupBy("document", "page").agg(F.sum("chars").alias("chars"), F.sum("images").alias("images"), F.bool_or(F.coalesce("blocked", F.lit(False))).alias("blocked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, request, n, c, i, broken = None, -1, 0, 0, 0, True
        for batch in batches:
            found = []
            for own, more, pictures, blocked in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if own != document:
                    document, request, broken = own, -1, True
                if blocked or more + overhead > chars or pictures > images:
                    found.append(None)
                    broken = True
                    continue
                if broken or n + 1 > pages or c + more > chars or i + pictures > images:
                    request, n, c, i, broken = request + 1, 0, overhead, 0, False
                n, c, i = n + 1, c + more, i + pictures
                found.append(request)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["document", "page", "request"])

    kinds = dict(page.dtypes)
    rows = page.filter("document is not null").repartition("document").sortWithinPartitions("document", "page").select("document", "page", F.col("chars").cast("long"), F.col("images").cast("long"), "blocked")
    return rows.mapInArrow(run, f"document {kinds['document']}, page {kinds['page']}, request long")
