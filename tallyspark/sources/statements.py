"""Statement rows from positioned words: columns by x-range, carried dates, continuation lines.

A layout is data: the x-ranges of its columns. A line with a date or an amount starts a row; other lines continue the
narration. Of several layouts tried on one source, it is accepted only if exactly one passes all checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import bank_cell


@dataclass(frozen=True)
class Layout:
    name: str
    columns: dict[str, tuple[float, float]]  # date, narration, money_in, money_out, balance
    newest_first: bool = False


def gathered(words: DataFrame) -> DataFrame:
    """One row a line (source, page, line, words), words being structs of x and text from left to right. A statement is in one partition, as its rows will be."""
    return words.select("source", "page", "line", "x", "text").repartition("source").groupBy("source", "page", "line").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("words"))


def printed_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def placed_lines(lines: DataFrame, layout: Layout, *more: str) -> DataFrame:
    """The lines of `gathered` with a text column for each column of the layout ("" where it has no word), without lines that have no word in any of them."""
    ranges = list(layout.columns.items())
    first = lambda k, x: (x >= ranges[k][1][0]) & (x < ranges[k][1][1]) & ~F.coalesce(*[F.when((x >= a) & (x < b), True) for _, (a, b) in ranges[:k]], F.lit(False))
    within = lambda k: F.filter("words", lambda w: F.coalesce(first(k, w["x"]), F.lit(False)))
    cells = {n: within(k) for k, (n, _) in enumerate(ranges)}
    some = F.exists("words", lambda w: F.coalesce(*[F.when((w["x"] >= a) & (w["x"] < b), True) for _, (a, b) in ranges], F.lit(False)))
    return lines.filter(some).select("source", "page", "line", *more, *[printed_text(c).alias(n) for n, c in cells.items()])


def lines_of(words: DataFrame, layout: Layout) -> DataFrame:
    """One row a line with a text column for each column of the layout: words (source, page, line, x, text)."""
    return placed_lines(gathered(words), layout)


def statement_rows(words: DataFrame, layout: Layout) -> DataFrame:
    """Rows (source, sequence, page, date_text, narration, money_in, money_out, balance)."""
    return rows_of_lines(lines_of(words, layout), layout)


def rows_of_lines(lines: DataFrame, layout: Layout) -> DataFrame:
    """The same from the lines of `placed_lines`."""
    for side in ("money_in", "money_out", "balance"):
        lines = lines.withColumn(side, bank_cell(F.trim(side)) if side in layout.columns else F.lit(None).cast("decimal(18,2)"))
    place = Window.partitionBy("source").orderBy("page", "line")
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.coalesce("money_in", "money_out").isNotNull()
    rows = lines.withColumn("date_text", F.last(F.nullif(F.trim("date"), F.lit("")), ignorenulls=True).over(so_far)).withColumn("row", F.sum(starts.cast("int")).over(so_far)).filter("row > 0")
    narration = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", "line", "narration"))), lambda x: x["narration"]), lambda t: t.isNotNull() & (t != "")), "\n")
    zero = F.lit(0).cast("decimal(18,2)")
    out = rows.groupBy("source", "row").agg(
        F.min("page").alias("page"), F.min_by("date_text", F.struct("page", "line")).alias("date_text"), narration.alias("narration"),
        F.coalesce(F.max("money_in"), zero).alias("money_in"), F.coalesce(F.max("money_out"), zero).alias("money_out"), F.max("balance").alias("balance"),
    )
    order = F.col("row").desc() if layout.newest_first else F.col("row")
    return out.withColumn("sequence", F.row_number().over(Window.partitionBy("source").orderBy(order))).drop("row")


def one_passing_layout(results: DataFrame) -> DataFrame:
    """Rows (source, layout, error) from (source, layout, passed): accepted only if exactly one layout passed."""
    passed = F.count_if("passed")
    return results.groupBy("source").agg(F.when(passed == 1, F.max(F.when(F.col("passed"), F.col("layout")))).alias("layout"), F.when(passed == 0, "no layout passes").when(passed > 1, "several layouts pass").alias("error"))


def overlapping_words(boxes: DataFrame) -> DataFrame:
    """Pages on which two words overlap by more than a unit in both directions: (source, page, i, x0, y0, x1, y1).

    Boxes meet only in cells of a grid that both touch, so a page is no all-pairs join.
    """
    size = 50
    cell = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    placed = boxes.withColumn("cx", F.explode(cell("x0", "x1"))).withColumn("cy", F.explode(cell("y0", "y1")))
    other = placed.select("source", "page", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("i", "x0", "y0", "x1", "y1")])
    both = placed.join(other, ["source", "page", "cx", "cy"]).filter("i < o_i")
    deep = (F.least("x1", "o_x1") - F.greatest("x0", "o_x0") > 1) & (F.least("y1", "o_y1") - F.greatest("y0", "o_y0") > 1)
    return both.filter(deep).select("source", "page").distinct()
