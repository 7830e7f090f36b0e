"""Statement controls: running balances, printed totals, dates and continuation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order)


def running_balance(rows: DataFrame, statement: str, order: list[str], opening: str = "opening") -> DataFrame:
    """Adds `calculated`: the opening balance plus all that came in less all that went out so far."""
    so_far = ordered([statement], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("calculated", (F.col(opening) + F.sum(F.col("money_in") - F.col("money_out")).over(so_far)).cast("decimal(18,2)"))


def balance_violations(rows: DataFrame, statement: str, order: list[str]) -> DataFrame:
    """Per statement the first row whose printed balance isn't the calculated one, and how many there are."""
    wrong = rows.filter(F.col("balance").isNotNull() & (F.col("calculated") != F.col("balance")))
    key = F.struct(*order)
    first = F.min_by(F.struct(*[F.col(c) for c in order], "balance", "calculated"), key)
    out = wrong.groupBy(statement).agg(first.alias("f"), F.count("*").alias("n_wrong"))
    return out.select(statement, *[F.col(f"f.{c}").alias(c) for c in order], "f.balance", "f.calculated", "n_wrong")


def one_sided(money_in, money_out, zero_allowed: bool = False):
    """Exactly one side is positive; a zero pair only where the layout allows it."""
    zero = (money_in == 0) & (money_out == 0)
    return (F.least(money_in, money_out) >= 0) & (((money_in > 0) != (money_out > 0)) | (F.lit(zero_allowed) & zero))


def statement_totals(rows: DataFrame, statement: str) -> DataFrame:
    return rows.groupBy(statement).agg(
        F.sum("money_in").cast("decimal(18,2)").alias("total_in"), F.sum("money_out").cast("decimal(18,2)").alias("total_out"),
        F.count_if(F.col("money_in") > 0).alias("n_in"), F.count_if(F.col("money_out") > 0).alias("n_out"),
    )


def validate_statement(rows: DataFrame, printed: DataFrame, statement: str, order: list[str]) -> DataFrame:
    """Rows (statement, check) of every check that fails: sides, balances, closing balance, totals and counts."""
    balanced = running_balance(rows, statement, order)
    # One pass over the rows: the sums stand where the running balance was taken.
    facts = balanced.groupBy(statement).agg(
        F.bool_or(~one_sided(F.col("money_in"), F.col("money_out"))).alias("sides"), F.bool_or(F.col("balance").isNotNull() & (F.col("calculated") != F.col("balance"))).alias("wrong"),
        F.max_by("calculated", F.struct(*order)).alias("end"), F.sum("money_in").cast("decimal(18,2)").alias("total_in"), F.sum("money_out").cast("decimal(18,2)").alias("total_out"),
    )
    totals = facts.join(printed, statement, "left")
    checks = [("one positive side", F.col("sides")), ("balance", F.col("wrong")), ("closing balance", F.col("end") != F.col("closing")), ("money in", F.col("total_in") != F.col("printed_in")), ("money out", F.col("total_out") != F.col("printed_out"))]
    return totals.select(statement, F.explode(F.array_compact(F.array(*[F.when(fails, name) for name, fails in checks]))).alias("check"))


def dates_out_of_order(rows: DataFrame, partition: list[str], order: list[str], date: str) -> DataFrame:
    before = F.lag(date).over(ordered(partition, order))
    return rows.withColumn("previous", before).filter(F.col("previous") > F.col(date))


def carried_forward(rows: DataFrame, partition: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last known value so far."""
    so_far = ordered(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(so_far))


def continuation_groups(lines: DataFrame, partition: str, order: str, is_start, text: str) -> DataFrame:
    """Rows (partition, group, first, lines, narration): a starting line and the lines that continue it."""
    so_far = ordered([partition], [order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("group", F.sum(is_start.cast("int")).over(so_far))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return numbered.groupBy(partition, "group").agg(F.min(order).alias("first"), F.count("*").alias("lines"), joined.alias("narration"))


def numbered(rows: DataFrame, partition: list[str], order: list[str], prefix) -> DataFrame:
    """Sequence number, its four-digit spelling after the prefix, and the short id."""
    n = F.row_number().over(ordered(partition, order))
    return rows.withColumn("sequence", n).withColumn("transaction_id", F.concat(prefix, F.lit(":"), F.lpad(F.col("sequence").cast("string"), 4, "0"))).withColumn("short_id", F.concat(F.lit("B"), F.col("sequence").cast("string")))


def header_constant(rows: DataFrame, statement: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(statement).agg((F.count_distinct(F.struct(*columns)) == 1).alias("constant"), F.count_distinct(F.struct(*columns)).alias("variants"))


def payee_backfill(rows: DataFrame, statement: str, row_id: str, party: str, line: str, heading: str | None = None) -> DataFrame:
    """Adds `filled`: a blank party takes the longest known one of its statement that starts or ends the line.

    Starts and ends of the line at word borders are the only possible names, so those of as many words as a known name
    of the statement has are exploded and equi-joined. Rows whose heading names a fee or a charge print no payee: they stay blank.
    """
    known = rows.filter(F.length(party) >= 6).select(statement, F.col(party).alias("_known")).distinct()
    words = F.split(F.col(line), " ")
    n = F.size(words)
    sizes = known.groupBy(statement).agg(F.collect_set(F.size(F.split("_known", " "))).alias("_sizes"))
    fits = F.filter("_sizes", lambda k: k < n)
    edges = F.array_distinct(F.concat(F.transform(fits, lambda k: F.array_join(F.slice(words, 1, k), " ")), F.transform(fits, lambda k: F.array_join(F.slice(words, n - k + 1, k), " "))))
    open_ = rows.filter((F.coalesce(F.col(party), F.lit("")) == "") & (n >= 2))
    if heading:
        open_ = open_.filter(~F.regexp_like(F.coalesce(F.col(heading), F.lit("")), F.lit(r"\bFEE\b|CHARGE")))
    open_ = open_.join(sizes, statement)
    found = open_.select(statement, row_id, F.explode(edges).alias("_known")).join(known, [statement, "_known"])
    best = found.groupBy(row_id).agg(F.max(F.struct(F.length("_known").alias("l"), "_known")).alias("b")).select(row_id, F.col("b._known").alias("_filled"))
    return rows.join(best, row_id, "left").withColumn("filled", F.coalesce(F.nullif(F.col(party), F.lit("")), "_filled")).drop("_filled")
