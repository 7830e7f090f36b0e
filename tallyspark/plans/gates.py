"""Queries of the gate, of acceptances and of submitted pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, reviews
from .standins import PIECES, pieces, plain, query, table

_UNITS = f"""
p AS ({PIECES}), u AS (
  SELECT document, row_number() OVER (PARTITION BY document ORDER BY item_id) AS unit_no, count(*) OVER (PARTITION BY document) AS units, part FROM p),
f AS (SELECT *, substr(CAST(document AS VARCHAR), 1, 10) AS short, CASE WHEN document % 13 = 0 THEN false ELSE true END AS accepted, CASE WHEN document % 17 = 0 THEN ' broken ' END AS error, CASE WHEN part % 19 = 0 THEN 'too dark' END AS blocked,
  CASE WHEN part % 23 = 0 THEN NULL ELSE part % 29 <> 0 END AS readable, document % 3 <> 0 AS assembled, CASE WHEN document % 31 = 0 THEN document + 1 END AS keeper, document % 62 = 0 AS keeper_present FROM u)
"""


@query(f"""
WITH {_UNITS}
SELECT document, unit_no, 'extraction failed' AS kind, short || ': extraction failed: broken' AS problem FROM f WHERE accepted AND unit_no = 1 AND error IS NOT NULL
UNION ALL SELECT document, unit_no, 'blocked', short || ' unit ' || unit_no || ': too dark' FROM f WHERE accepted AND blocked IS NOT NULL
UNION ALL SELECT document, unit_no, 'unread', short || ' unit ' || unit_no || ': unread or unreadable' FROM f WHERE accepted AND NOT coalesce(readable, false)
UNION ALL SELECT document, unit_no, 'assembly pending', short || ': receipt assembly pending' FROM f WHERE accepted AND unit_no = 1 AND units > 1 AND NOT assembled
UNION ALL SELECT document, unit_no, 'cleanup pending', short || ': admin duplicate cleanup pending; retain ' || keeper FROM f WHERE unit_no = 1 AND keeper IS NOT NULL
UNION ALL SELECT document, unit_no, 'survivor missing', keeper || ': selected survivor is missing' FROM f WHERE unit_no = 1 AND keeper IS NOT NULL AND NOT keeper_present
""")
def gate_problems(spark, sf_dir):
    return plain(gate.gate(gate_units(spark, sf_dir)))


def gate_units(spark, sf_dir):
    from pyspark.sql.window import Window

    own = Window.partitionBy("document")
    p = pieces(spark, sf_dir).select("document", "part", F.row_number().over(own.orderBy("item_id")).alias("unit_no"), F.count("*").over(own).alias("units"))
    d, k = F.col("document"), F.col("part")
    return p.select(
        "document", "unit_no", "units", (d % 13 != 0).alias("accepted"), F.when(d % 17 == 0, " broken ").alias("error"), F.when(k % 19 == 0, "too dark").alias("blocked"), F.when(k % 23 != 0, k % 29 != 0).alias("readable"),
        (d % 3 != 0).alias("assembled"), F.when(d % 31 == 0, d + 1).alias("keeper"), (d % 62 == 0).alias("keeper_present"))


@query(f"""
WITH p AS ({PIECES}), u AS (SELECT document, count(*) FILTER (part % 4 = 0) AS pieces, count(*) FILTER (part % 50 = 3) AS bad, count(*) FILTER (part % 60 = 7) AS matches FROM p GROUP BY document)
SELECT document, CASE WHEN document % 41 = 0 THEN 'source changed' WHEN pieces = 0 AND document % 2 = 0 THEN 'no entries and not supporting evidence' WHEN pieces > 0 AND document % 5 = 1 AND document % 2 = 1 THEN 'supporting evidence with entries'
  WHEN document % 37 = 0 THEN 'in trash' WHEN document % 11 = 5 THEN 'regeneration unfinished' WHEN document % 43 = 0 THEN 'assembly pending' WHEN matches > 0 THEN 'accepted matches' WHEN bad > 0 THEN 'unreadable amount' END AS refusal
FROM u WHERE NOT (pieces = 0 AND document % 2 = 1 AND document % 5 <> 1) OR document % 2 = 0
""")
def acceptances(spark, sf_dir):
    d = F.col("document")
    u = pieces(spark, sf_dir).groupBy("document").agg(F.count_if(F.col("part") % 4 == 0).alias("pieces"), F.count_if(F.col("part") % 50 == 3).alias("bad_amounts"), F.count_if(F.col("part") % 60 == 7).alias("accepted_matches"))
    u = u.filter(~((F.col("pieces") == 0) & (d % 2 == 1) & (d % 5 != 1)))
    u = u.withColumns({"supporting_only": (d % 2 == 1) & (d % 5 == 1), "source_changed": d % 41 == 0, "trash": d % 37 == 0, "regeneration": F.when(d % 11 == 5, "running").when(d % 11 == 6, "completed"), "assembly_pending": d % 43 == 0})
    return plain(gate.acceptance(u).select("document", "refusal"))


@query("""
WITH r AS (SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)
SELECT document, pos, CASE pos % 7 WHEN 1 THEN 'p' || pos WHEN 2 THEN 'p1' WHEN 3 THEN 'x' || pos END AS piece_id,
  CASE pos % 7 WHEN 1 THEN 'kept' WHEN 4 THEN 'added' WHEN 5 THEN 'split' WHEN 6 THEN 'merged' END AS lineage,
  CASE pos % 7 WHEN 2 THEN 'unknown or repeated id' WHEN 3 THEN 'unknown or repeated id' WHEN 0 THEN 'unknown parent' END AS problem FROM r
""")
def submitted_lineage(spark, sf_dir):
    """The pieces of an order come back: some as they were, one again, one made up, some split, merged or of unknown parents."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.row_number().over(w).alias("pos"))
    text, k = F.col("pos").cast("string"), F.col("pos") % 7
    existing = rows.select("document", F.concat(F.lit("p"), text).alias("piece_id"), F.when(k == 1, F.array(F.lit("old"))).alias("parents"))
    piece = F.when(k == 1, F.concat(F.lit("p"), text)).when(k == 2, F.lit("p1")).when(k == 3, F.concat(F.lit("x"), text)).when(k == 4, F.lit(" "))
    parents = F.when(k == 1, F.array(F.lit("old"))).when(k == 5, F.array(F.lit("p1"))).when(k == 6, F.array(F.lit("p1"), F.lit("p2"))).when(k == 0, F.array(F.lit("p1"), F.lit("q9")))
    return plain(gate.submitted_lineage(rows.select("document", "pos", piece.alias("piece_id"), parents.alias("parents")), existing))


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS item_id, l_orderkey AS bank_id FROM lineitem)
SELECT item_id, bank_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, c_name AS party, 'inv' || o_orderkey AS reference FROM c JOIN orders ON o_orderkey = bank_id JOIN customer ON c_custkey = o_custkey
WHERE item_id IN (SELECT item_id FROM c WHERE bank_id % 50 = 7)
""")
def competing_facts(spark, sf_dir):
    """The other lines of every candidate of one batch, with their amounts, parties and references."""
    choices = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("bank_id"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    banks = o.select(F.col("o_orderkey").alias("bank_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("c_name").alias("party"), F.concat(F.lit("inv"), F.col("o_orderkey").cast("string")).alias("reference"))
    return plain(reviews.competing_facts(choices, banks, banks.filter("bank_id % 50 = 7")))


@query(f"""
WITH p AS ({PIECES}), r AS (SELECT document AS page, count(*) AS n, min(CAST(amount AS VARCHAR)) AS total, bool_or(part % 17 = 0) AS limited, bool_or(part % 19 = 0) AS foreign_, bool_or(part % 23 = 0) AS odd, bool_or(part % 5 = 0) AS shown FROM p GROUP BY document)
SELECT page, array_to_string(list_sort(list_filter([
  CASE WHEN page % 29 = 0 OR limited THEN 'uncertain_text_extraction' END, CASE WHEN page % 31 = 0 THEN 'ambiguous_receipt_boundaries' END, CASE WHEN foreign_ THEN 'conflicting_totals_or_currencies' END,
  CASE WHEN page % 31 <> 0 AND odd THEN 'incomplete_receipt' END, CASE WHEN page % 31 <> 0 AND NOT odd AND page % 37 = 0 THEN 'unsupported_currency' END,
  CASE WHEN page % 31 <> 0 AND NOT shown THEN 'unsupported_invoice_1' END, CASE WHEN page % 31 <> 0 AND page % 3 = 0 THEN 'unsupported_total' END], lambda x: x IS NOT NULL)), ',') AS errors FROM r
""")
def page_errors(spark, sf_dir):
    """A page an order: one receipt (none on some), with words that show its facts or not."""
    d = F.col("page")
    r = pieces(spark, sf_dir).groupBy(F.col("document").alias("page")).agg(
        F.min(F.col("amount").cast("string")).alias("total"), *[F.bool_or(F.col("part") % m == 0).alias(n) for m, n in ((17, "limited"), (19, "foreign"), (23, "odd"), (5, "shown"))])
    text, none = d.cast("string"), F.array().cast("array<string>")
    receipt = F.struct(F.lit("receipt").alias("document_type"), F.col("total"), F.when(F.col("odd"), "").otherwise("MYR").alias("currency"), F.array(F.concat(F.lit("A"), text), F.concat(F.lit("B"), text)).alias("invoice_numbers"), none.alias("limitations"))
    money = F.array(*[F.struct(F.lit(role).alias("role"), F.col("total").alias("amount"), currency.alias("currency")) for role, currency in (("grand_total", F.lit("MYR")), ("tax", F.lit("EUR")))])
    totals = F.array(F.struct(F.lit("Invoice Total").alias("label"), F.col("total").alias("amount"), F.when(F.col("foreign"), "USD").otherwise("MYR").alias("currency")))
    results = r.select("page", (d % 29 != 0).alias("readable"), F.when(F.col("limited"), F.array(F.lit("cut off"))).alias("limitations"), none.alias("review_warnings"), F.when(d % 31 != 0, F.array(receipt)).alias("receipts"), money.alias("money"), totals.alias("totals"))
    words = r.select("page", F.explode(F.array_compact(F.array(
        F.when(d % 37 != 0, "(MYR)"), F.when(d % 3 != 0, F.concat("total", F.lit(";"))), F.when(d % 3 == 0, F.concat(F.lit("1"), "total")), F.concat(F.lit("A"), text, F.lit(": ")), F.when(F.col("shown"), F.concat(F.lit("B"), text))))).alias("text"))
    return plain(reviews.page_errors(results, words).select("page", F.array_join("errors", ",").alias("errors")))
