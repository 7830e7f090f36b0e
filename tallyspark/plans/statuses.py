"""Queries of results, statuses and decisions. Facts that the tables don't have are derived from their columns by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews
from .standins import BANKS, PIECES, bank_lines, pieces, plain, query, table


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE '' END) || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '5' AS amount, CASE WHEN l_linenumber % 2 = 0 THEN substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7) ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS date, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'rm' WHEN 2 THEN ' usd ' ELSE 'MYR' END AS currency FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(round(abs(CAST(amount AS DECIMAL(28,3))), 2) AS DOUBLE) AS amount, CASE WHEN length(date) = 7 THEN CAST(CAST(last_day(CAST(date || '-01' AS DATE)) AS DATE) AS VARCHAR) ELSE date END AS date, CASE WHEN trim(currency) = '' THEN 'MYR' WHEN upper(trim(currency)) = 'RM' THEN 'MYR' ELSE upper(trim(currency)) END AS currency, trim(currency) = '' AS currency_default FROM r
""")
def clean_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    amount = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "-").otherwise(""), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("5"))
    date = F.col("l_shipdate").cast("date").cast("string")
    kind = F.col("l_linenumber") % 4
    raw = rows.select("l_orderkey", "l_linenumber", amount.alias("amount"), F.when(F.col("l_linenumber") % 2 == 0, F.substring(date, 1, 7)).otherwise(date).alias("date"), F.when(kind == 0, "").when(kind == 1, "rm").when(kind == 2, " usd ").otherwise("MYR").alias("currency"))
    return plain(reviews.clean_piece(raw).withColumn("amount", F.col("amount").cast("double")))


@query("""
SELECT l_orderkey, count(*) AS skipped FROM lineitem WHERE l_quantity < 10 GROUP BY l_orderkey
""")
def zero_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 10, "0.00").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("amount"))
    return plain(reviews.without_zero(rows, "l_orderkey")[1])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS piece_type, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_suppkey AS VARCHAR) END AS document_number, '' AS payer FROM lineitem
""")
def canonical_pieces(spark, sf_dir):
    when = lambda n, c: F.when(F.col("l_linenumber") % n == 0, F.col(c).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", when(2, "l_returnflag").alias("piece_type"), F.col("l_linestatus").alias("document_type"), when(3, "l_partkey").alias("document_number"), F.col("l_suppkey").cast("string").alias("invoice_number"))
    return plain(reviews.canonical(rows).select("l_orderkey", "l_linenumber", "piece_type", "document_number", "payer"))


#: Facts of documents, in words that both engines understand.
FACTS = [
    "doc_id", "doc_id % 13 = 0 AS discarded", "CASE WHEN doc_id % 17 = 0 THEN 'cannot be read' ELSE '' END AS error", "doc_id % 19 = 0 AS blocked", "1 + n_chars % 4 AS units", "CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 ELSE 1 + n_chars % 4 END AS read",
    "doc_id % 23 = 0 AS unreadable", "doc_id % 3 <> 0 AS assembled", "n_chars % 3 AS pieces", "CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars % 3 END AS reviewed", "doc_id % 11 <> 0 AS accepted", "CASE WHEN doc_id % 29 = 0 THEN 'k' END AS keeper",
]


@query(f"""
WITH f AS (SELECT {', '.join(FACTS)} FROM documents),
s AS (SELECT *, CASE WHEN discarded THEN 'Trash' WHEN error <> '' OR blocked THEN 'Needs attention' WHEN read < units AND read = 0 THEN 'Queued' WHEN read < units THEN 'Processing' WHEN unreadable THEN 'Needs attention'
  WHEN units > 1 AND NOT assembled THEN 'Processing' WHEN pieces = 0 OR reviewed < pieces THEN 'Needs review' ELSE 'Complete' END AS status FROM f)
SELECT doc_id, status, CASE WHEN keeper IS NOT NULL OR status = 'Trash' THEN 'excluded' WHEN status = 'Complete' THEN 'complete' WHEN status = 'Needs attention' THEN 'attention' ELSE 'review' END AS category,
  CASE WHEN NOT accepted THEN 'not_accepted' WHEN error <> '' THEN 'unresolved' WHEN keeper IS NOT NULL THEN 'confirmed_duplicate' WHEN blocked OR unreadable THEN 'unresolved' WHEN read < units THEN 'extraction_pending' ELSE 'extracted' END AS state FROM s
""")
def document_statuses(spark, sf_dir):
    rows = reviews.inventory_status(reviews.document_status(table(spark, sf_dir, "documents").selectExpr(*FACTS)))
    return plain(rows.select("doc_id", "status", reviews.document_category(F.col("keeper").isNotNull(), F.col("status")).alias("category"), "state"))


@query(f"""
WITH f AS (SELECT {', '.join(FACTS)} FROM documents)
SELECT count(*) AS documents, CAST(sum(least(read, units)) AS BIGINT) AS units_read, CAST(sum(units) AS BIGINT) AS units_total, CAST(floor(sum(least(read, units)) * 100.0 / sum(units)) AS BIGINT) AS percent, count(*) FILTER (read >= units AND NOT unreadable) AS complete, count(*) FILTER (NOT (read >= units AND NOT unreadable)) AS unresolved FROM f
""")
def extraction_progress(spark, sf_dir):
    f = table(spark, sf_dir, "documents").selectExpr(*FACTS)
    read, whole = F.sum(F.least("read", "units")), (F.col("read") >= F.col("units")) & ~F.col("unreadable")
    return plain(f.agg(F.count("*").alias("documents"), read.alias("units_read"), F.sum("units").alias("units_total"), F.floor(read * 100 / F.sum("units")).alias("percent"), F.count_if(whole).alias("complete"), F.count_if(~whole).alias("unresolved")))


@query("""
WITH g AS (SELECT source, lang, count(*) % 3 <> 0 AS done FROM documents WHERE lang IS NOT NULL GROUP BY source, lang),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) AS number FROM g)
SELECT source, number, lang AS name, CASE WHEN done AND coalesce(bool_and(done) OVER (PARTITION BY source ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) THEN lead(lang) OVER (PARTITION BY source ORDER BY number) END AS next FROM n
""")
def workflow_steps(spark, sf_dir):
    from pyspark.sql.window import Window

    g = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("source", "lang").agg((F.count("*") % 3 != 0).alias("done"))
    stages = g.withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy("lang"))).withColumnRenamed("lang", "name")
    return plain(reviews.stage_steps(stages, "source").select("source", "number", "name", "next"))


_STALE = f"""
p AS ({PIECES}),
i AS (SELECT DISTINCT item_id, document, flag AS revision, supplier % 50 = 0 AS excluded, part % 97 = 0 AS retired, CASE WHEN part % 89 = 0 THEN -1 ELSE document END AS document_hash FROM p),
a AS (SELECT document AS bank_id, item_id, CASE WHEN line = 3 AND document % 3 = 0 THEN 'Z' ELSE flag END AS revision FROM p WHERE document % 2 = 0),
moved AS (SELECT bank_id, bool_or(i.excluded OR i.retired OR i.document_hash <> i.document OR a.revision <> i.revision) AS moved FROM a JOIN i USING (item_id) GROUP BY bank_id)
"""


@query(f"""
WITH {_STALE}
SELECT o_orderkey AS bank_id, o_orderkey % 11 = 0 OR (o_orderkey % 2 = 0 AND (coalesce(moved, FALSE) OR o_orderkey % 14 = 0)) AS stale, row_number() OVER (ORDER BY o_orderkey) AS report_index FROM orders LEFT JOIN moved ON bank_id = o_orderkey
""")
def stale_decisions(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), pieces(spark, sf_dir)
    key = F.col("o_orderkey")
    banks = o.select(key.alias("bank_id"), F.col("o_orderstatus").alias("source_hash"), F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("recorded_hash"), F.col("o_orderpriority").alias("revision"))
    decisions = o.filter(key % 2 == 0).select(key.alias("bank_id"), F.when(key % 14 == 0, "old").otherwise(F.col("o_orderpriority")).alias("bank_revision"))
    own = p.filter("document % 2 = 0").select(F.col("document").alias("bank_id"), "item_id", F.when((F.col("line") == 3) & (F.col("document") % 3 == 0), "Z").otherwise(F.col("flag")).alias("revision"))
    items = p.select("item_id", F.col("flag").alias("revision"), (F.col("supplier") % 50 == 0).alias("excluded"), (F.col("part") % 97 == 0).alias("retired"), "document", F.when(F.col("part") % 89 == 0, -1).otherwise(F.col("document")).alias("document_hash")).distinct()
    return plain(reviews.decision_staleness(banks, decisions, own, items).select("bank_id", "stale", "report_index"))


@query("""
SELECT o_orderkey AS bank_id, (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0) AND o_orderkey % 5 <> 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 7 = 0) AS optional FROM orders
""")
def optional_reviews(spark, sf_dir):
    k = F.col("o_orderkey")
    level = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 4 == 0, "none").otherwise("high")
    return plain(table(spark, sf_dir, "orders").select(k.alias("bank_id"), reviews.review_optional(level, k % 5 == 0, k % 2 == 1, k % 7 == 0).alias("optional")))


@query("""
SELECT o_orderkey AS bank_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE upper(o_orderpriority) END AS counterparty, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS money_in, CASE WHEN o_orderkey % 2 = 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS money_out,
  CAST(o_custkey AS DOUBLE) AS balance, CASE WHEN o_orderkey % 5 = 0 THEN 'REVIEW PAY TO' ELSE 'PENDING' END AS status FROM orders
""")
def transaction_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    side = lambda r, name: F.when(k % 2 == r, F.col("o_totalprice")).otherwise(0).alias(name)
    rows = table(spark, sf_dir, "orders").select(k.alias("bank_id"), F.col("o_orderdate").alias("date"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("counterparty"), side(0, "money_in"), side(1, "money_out"), F.col("o_custkey").alias("balance"))
    return plain(reviews.transaction_values(rows))


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS bank_id, l_partkey % 500 AS document FROM lineitem), b AS (SELECT DISTINCT document FROM t WHERE bank_id % 100 = 0)
SELECT bank_id, document FROM t JOIN b USING (document) WHERE bank_id % 100 <> 0
""")
def related_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    choices = rows.select(F.col("l_orderkey").alias("bank_id"), F.col("l_partkey").alias("item_id"))
    items = rows.select(F.col("l_partkey").alias("item_id"), (F.col("l_partkey") % 500).alias("document")).distinct()
    return plain(reviews.related_lines(choices, items, choices.select("bank_id").filter("bank_id % 100 = 0").distinct()))


@query("SELECT l_partkey AS item_id, count(DISTINCT l_orderkey) AS lines FROM lineitem GROUP BY l_partkey")
def competing_lines(spark, sf_dir):
    return plain(reviews.competing_lines(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("bank_id"))))


_REPORT = f"""
p AS ({PIECES}), c AS (SELECT part AS item_id, sum(amount) AS capacity, max(supplier) % 7 = 0 AS open, part % 40 AS document, CASE WHEN part % 31 = 0 THEN NULL ELSE 'MYR' END AS currency FROM p GROUP BY part),
r AS (SELECT document AS bank_id, part AS item_id, CASE WHEN line = 1 AND document % 6 = 0 THEN 3 * amount ELSE amount END AS amount, CASE WHEN document % 4 = 0 THEN 'tentative' ELSE 'strong' END AS assessment FROM p),
t AS (SELECT document AS bank_id, CASE WHEN document % 9 = 0 THEN sum(amount) + 1 ELSE sum(CASE WHEN line = 1 AND document % 6 = 0 THEN 3 * amount ELSE amount END) END AS bank_amount FROM p GROUP BY document),
l AS (SELECT bank_id, any_value(r.assessment) AS assessment, any_value(bank_amount) <> sum(r.amount) OR bool_or(c.currency IS NULL) AS wrong FROM r JOIN t USING (bank_id) JOIN c USING (item_id) GROUP BY bank_id),
s AS (SELECT r.* FROM r JOIN l USING (bank_id) WHERE l.assessment = 'strong' AND NOT wrong),
o AS (SELECT DISTINCT bank_id FROM s WHERE item_id IN (SELECT item_id FROM s JOIN c USING (item_id) GROUP BY item_id HAVING sum(amount) > any_value(capacity))),
d AS (SELECT bank_id, c.document FROM s JOIN c USING (item_id) WHERE c.open AND bank_id NOT IN (SELECT bank_id FROM o)),
m AS (SELECT DISTINCT bank_id FROM d WHERE document IN (SELECT document FROM d GROUP BY document HAVING count(DISTINCT bank_id) > 1))
"""


@query(f"""
WITH {_REPORT}, x AS (SELECT bank_id, assessment, CASE WHEN assessment = 'strong' AND wrong THEN 'amount difference or missing facts' WHEN bank_id IN (SELECT bank_id FROM o) THEN 'competing payments exceed the piece' WHEN bank_id IN (SELECT bank_id FROM m) THEN 'several payments use an unassembled source' END AS problem FROM l)
SELECT bank_id, CASE WHEN problem IS NULL THEN assessment ELSE 'tentative' END AS assessment, problem FROM x
""")
def report_checks(spark, sf_dir):
    p = pieces(spark, sf_dir)
    amount = F.when((F.col("line") == 1) & (F.col("document") % 6 == 0), 3 * F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)")
    items = p.groupBy(F.col("part").alias("item_id")).agg(F.sum("amount").alias("amount"), (F.max("supplier") % 7 == 0).alias("boundary_unresolved")).withColumn("document", F.col("item_id") % 40).withColumn("currency", F.when(F.col("item_id") % 31 != 0, "MYR"))
    banks = p.groupBy(F.col("document").alias("bank_id")).agg(F.when(F.first("document") % 9 == 0, F.sum("amount") + 1).otherwise(F.sum(amount)).cast("decimal(18,2)").alias("bank_amount")).withColumn("currency", F.lit("MYR"))
    proposals = p.select(F.col("document").alias("bank_id"), F.col("part").alias("item_id"), amount.alias("amount"), F.when(F.col("document") % 4 == 0, "tentative").otherwise("strong").alias("assessment"))
    return plain(reviews.report_checks(proposals, banks, items))


@query("""
WITH g AS (SELECT l_orderkey AS document, range(1, CAST(count(*) AS BIGINT) + 1) AS expected, list(l_linenumber) AS reviewed, list(l_linenumber) FILTER (l_returnflag = 'R') AS a, list(l_linenumber + 1) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY l_orderkey),
r AS (SELECT document, expected, reviewed, coalesce(a, []) AS a, coalesce(b, []) AS b FROM g)
SELECT document, CASE WHEN len(reviewed) <> len(list_distinct(reviewed)) THEN 'repeats a reviewed unit' WHEN NOT (list_has_all(expected, reviewed) AND list_has_all(reviewed, expected)) THEN 'did not review every unit'
  WHEN len(a) <> len(list_distinct(a)) OR len(b) <> len(list_distinct(b)) THEN 'receipt repeats a unit' WHEN NOT (list_has_all(expected, a) AND list_has_all(expected, b)) THEN 'receipt of an unknown unit' END AS failure FROM r
""")
def assembly_failures(spark, sf_dir):
    n = F.col("l_linenumber").cast("bigint")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(
        F.sequence(F.lit(1).cast("bigint"), F.count("*")).alias("expected"), F.collect_list(n).alias("reviewed"), F.array(F.collect_list(F.when(F.col("l_returnflag") == "R", n)), F.collect_list(F.when(F.col("l_linestatus") == "O", n + 1))).alias("receipts")
    )
    return plain(reviews.assembly_failures(rows).select("document", "failure"))


@query("SELECT l_orderkey AS document FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_linenumber = 4)")
def current_assemblies(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("unit_no"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_quantity").alias("result"))
    old = units.withColumn("result", F.when(F.col("unit_no") == 4, "old").otherwise(F.col("result")))
    spelled = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_no", "result"))), lambda u: F.concat_ws("\x1f", u["unit_no"], F.coalesce(u["result"], F.lit("")))), "\x1e"), 256)
    return plain(reviews.current_assemblies(old.groupBy("document").agg(spelled.alias("input_revision")), units).select("document"))


@query("""
WITH a AS (SELECT o_orderkey AS bank_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS account FROM orders WHERE o_orderkey % 17 <> 0),
b AS (SELECT o_orderkey AS bank_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status, CAST(o_custkey AS VARCHAR) AS account FROM orders WHERE o_orderkey % 19 <> 0),
j AS (SELECT coalesce(a.bank_id, b.bank_id) AS bank_id, a.status AS s1, b.status AS s2, a.account AS a1, b.account AS a2 FROM a FULL JOIN b ON a.bank_id = b.bank_id)
SELECT bank_id, 'status' AS "column", s1 AS saved, s2 AS fresh FROM j WHERE s1 IS DISTINCT FROM s2 UNION ALL SELECT bank_id, 'account', a1, a2 FROM j WHERE a1 IS DISTINCT FROM a2
""")
def master_drift(spark, sf_dir):
    b = bank_lines(spark, sf_dir).select("bank_id", "status", "account")
    fresh = b.filter("bank_id % 19 != 0").withColumn("status", F.when(F.col("bank_id") % 10 != 0, F.col("status")))
    return plain(reviews.row_drift(b.filter("bank_id % 17 != 0"), fresh, ["bank_id"], ["status", "account"]))


@query("SELECT o_orderkey AS bank_id, CAST(o_custkey AS VARCHAR) AS account FROM orders")
def recovered_columns(spark, sf_dir):
    b = bank_lines(spark, sf_dir).select("bank_id", "bank_date", F.col("account").cast("string").alias("account"))
    rows = b.withColumn("account", F.when(F.col("bank_id") % 4 == 0, "").when(F.col("bank_id") % 4 != 1, F.col("account")))
    return plain(reviews.recovered(rows, b, "bank_id", ["bank_date"], ["account"]).select("bank_id", "account"))


@query(f"WITH p AS ({PIECES}), k AS (SELECT DISTINCT item_id, line % 4 = 0 AS retired FROM p) SELECT item_id, retired FROM k")
def retired_pieces(spark, sf_dir):
    p = pieces(spark, sf_dir).select("item_id", "line").distinct()
    return plain(reviews.with_retired(p.filter("line % 4 != 0"), p.filter("line % 2 = 0"), "item_id").select("item_id", "retired"))


@query("""
SELECT o_orderkey AS bank_id, CASE WHEN o_orderkey % 6 IN (1, 2) AND o_orderkey % 3 <> 0 THEN 'tentative' WHEN o_orderkey % 3 = 0 THEN 'strong' ELSE 'none' END AS assessment, o_orderkey % 6 IN (1, 2) AND o_orderkey % 3 <> 0 AS followed FROM orders
""")
def second_opinions(spark, sf_dir):
    b = bank_lines(spark, sf_dir)
    first = b.select("bank_id", F.when(F.col("bank_id") % 3 == 0, "strong").otherwise("none").alias("assessment"))
    second = b.filter("bank_id % 6 in (0, 1, 2, 3)").select("bank_id", F.when(F.col("bank_id") % 6 == 3, "none").otherwise("strong").alias("assessment"))
    return plain(reviews.followed_up(first, second).select("bank_id", "assessment", "followed"))


@query("SELECT l_orderkey AS document, l_linenumber AS page, CAST(floor((dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) / 2.0) AS BIGINT) AS page_group FROM lineitem")
def page_groups(spark, sf_dir):
    return plain(reviews.page_groups(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page")), 2))


@query("SELECT DISTINCT 'Page ' || l_linenumber || '-' || l_partkey AS name, 'page ' || lpad(CAST(l_linenumber AS VARCHAR), 20, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 20, '0') AS natural_key FROM lineitem")
def natural_names(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Page "), "l_linenumber", F.lit("-"), "l_partkey").alias("name")).distinct()
    return plain(names.withColumn("natural_key", reviews.natural_key(F.col("name"))))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(lower(concat_ws(' ', o_orderkey, o_orderstatus, o_orderpriority)), '7 f 1-u')")
def report_search(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(reviews.matches_search("7 F 1-U", "o_orderkey", "o_orderstatus", "o_orderpriority"))
    return plain(rows.select("o_orderkey", "o_orderstatus"))


@query("SELECT bank_id FROM (SELECT o_orderkey AS bank_id FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderkey LIMIT 100)")
def shown_problems(spark, sf_dir):
    return plain(reviews.shown_problems(bank_lines(spark, sf_dir).filter("bank_id % 3 = 0").select("bank_id"), ["bank_id"])[0])


@query("SELECT source AS path, count(DISTINCT lang) AS hashes FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def conflicting_hashes(spark, sf_dir):
    return plain(reviews.conflicting_hashes(table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("lang").alias("hash"))))


@query("SELECT lower(substr(text, 1, 12)) AS name, count(*) AS entries FROM documents WHERE text IS NOT NULL GROUP BY lower(substr(text, 1, 12)) HAVING count(*) > 1")
def clashing_names(spark, sf_dir):
    return plain(reviews.clashing_names(table(spark, sf_dir, "documents").filter("text is not null").select(F.substring("text", 1, 12).alias("name"))))


@query(r"""
SELECT page_id, CAST(page_id AS VARCHAR) || '-' || CASE WHEN c = '' THEN 'Transaction' ELSE c END AS folder, NOT list_bool_or(list_transform(string_split(url, '/'), lambda p: p IN ('..', '.') OR contains(p, '\') OR contains(p, ':'))) AS portable
FROM (SELECT page_id, url, rtrim(substr(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), ' .'), 1, 100), ' .') AS c FROM pages WHERE url IS NOT NULL)
""")
def archive_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    return plain(pages.select("page_id", reviews.folder_name(F.col("page_id"), F.col("url")).alias("folder"), reviews.portable_path(F.col("url")).alias("portable")))


@query("SELECT DISTINCT c, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c, ''), lambda x: CAST(ascii(x) - 64 AS BIGINT))), lambda n, x: n * 26 + x) AS number FROM (SELECT chr(CAST(65 + l_partkey % 26 AS INTEGER)) || chr(CAST(65 + l_suppkey % 26 AS INTEGER)) AS c FROM lineitem)")
def column_numbers(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.char((65 + F.col("l_partkey") % 26).cast("bigint")), F.char((65 + F.col("l_suppkey") % 26).cast("bigint"))).alias("c")).distinct()
    return plain(names.withColumn("number", reviews.column_number(F.col("c"))))


@query("""
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, n_chars > 3000 AS risky, CASE doc_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'compare' ELSE 'text' END AS mode, lang = 'en' AS approved FROM documents)
SELECT doc_id, CASE WHEN risky OR (mode = 'hybrid' AND NOT coalesce(approved, FALSE)) OR mode = 'compare' OR CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 10 = 0 THEN 'vision' ELSE 'text' END AS route FROM s
""")
def page_routes(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 3 == 0, "hybrid").when(F.col("doc_id") % 3 == 1, "compare").otherwise("text")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") > 3000, "long_page")))
    return plain(table(spark, sf_dir, "documents").select("doc_id", reviews.page_route(mode, reasons, F.col("lang") == "en", F.coalesce("text", F.lit(""))).alias("route")))


@query("""
SELECT DISTINCT document, value FROM (SELECT l_orderkey AS document, CAST(l_partkey AS VARCHAR) AS value FROM lineitem) v WHERE NOT EXISTS (SELECT 1 FROM lineitem w WHERE w.l_linenumber % 2 = 0 AND w.l_orderkey = v.document AND CAST(w.l_partkey AS VARCHAR) = v.value)
""")
def evidence_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_partkey").cast("string").alias("value"), "l_linenumber")
    words = rows.filter("l_linenumber % 2 = 0").select("document", F.col("value").alias("word"))
    return plain(reviews.evidence_problems(rows.select("document", "value").distinct(), words))


@query("SELECT o_orderkey AS key, o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS reused FROM orders")
def resumed_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("request_revision"))
    results = o.filter("key % 3 != 0").select("key", F.when(F.col("key") % 4 == 0, "old").otherwise(F.col("request_revision")).alias("request_revision"), F.lit("r").alias("result"))
    done, again = reviews.resumable(o, results)
    return plain(done.select("key", F.lit(True).alias("reused")).unionByName(again.select("key", F.lit(False).alias("reused"))))


@query("""
WITH e AS (SELECT l_orderkey AS bank_id, l_partkey AS version, CASE WHEN l_returnflag = 'R' THEN 'undo' ELSE 'accept' END AS kind, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem),
u AS (SELECT bank_id, version, max(kind) AS kind, max(value) AS value FROM e GROUP BY bank_id, version), n AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY version DESC) AS n FROM u)
SELECT bank_id, version, CASE WHEN kind <> 'undo' THEN value END AS value FROM n WHERE n = 1
""")
def decisions_in_force(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bank_id"), F.col("l_partkey").alias("version"), F.when(F.col("l_returnflag") == "R", "undo").otherwise("accept").alias("kind"), F.col("l_suppkey").cast("string").alias("value"))
    return plain(reviews.latest_state(rows.groupBy("bank_id", "version").agg(F.max("kind").alias("kind"), F.max("value").alias("value")), "bank_id"))


@query("SELECT o_orderkey AS bank_id, CASE WHEN o_orderkey % 6 = 0 THEN 'written' ELSE o_orderpriority END AS description, o_orderkey % 6 = 0 AS overridden FROM orders")
def overridden_descriptions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bank_id"), F.col("o_orderstatus").alias("revision"), F.col("o_orderpriority").alias("description"))
    saved = o.filter("bank_id % 2 = 0").select("bank_id", F.when(F.col("bank_id") % 3 == 0, F.col("revision")).otherwise("old").alias("revision"), F.lit("written").alias("value"))
    return plain(reviews.overridden(o, saved, "bank_id", "description").select("bank_id", "description", "overridden"))


@query(f"""
WITH p AS ({PIECES}), c AS (SELECT DISTINCT document % 100 AS batch, document AS bank_id, part % 300 AS doc FROM p), d AS (SELECT DISTINCT batch, doc FROM c)
SELECT batch, lines, documents, chars FROM (SELECT batch, count(DISTINCT bank_id) AS lines FROM c GROUP BY batch) JOIN (SELECT batch, count(*) AS documents, CAST(sum(100 + doc) AS BIGINT) AS chars FROM d GROUP BY batch) USING (batch)
""")
def batch_sizes(spark, sf_dir):
    p = pieces(spark, sf_dir).select((F.col("document") % 100).alias("batch"), F.col("document").alias("bank_id"), (F.col("part") % 300).alias("document"))
    return plain(reviews.batch_sizes(p, p.select("document").distinct().withColumn("chars", 100 + F.col("document"))))


@query("""
WITH n AS (SELECT o_orderkey AS bank_id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, CASE o_orderstatus WHEN 'F' THEN 15 WHEN 'O' THEN 10 ELSE 5 END AS quota FROM orders)
SELECT bank_id, status FROM (SELECT * FROM n ORDER BY n > quota, bank_id LIMIT 50)
""")
def stratified_cases(spark, sf_dir):
    rows = bank_lines(spark, sf_dir).select("bank_id", "status")
    return plain(reviews.stratified(rows, "status", {"F": 15, "O": 10, "P": 5}, 50, F.col("bank_id")))


@query(f"WITH b AS ({BANKS}) SELECT account, count(*) AS lines, count(*) FILTER (status = 'F') AS matched, bool_and(status = 'F') AS complete FROM b GROUP BY account")
def bank_summary(spark, sf_dir):
    matched = F.col("status") == "F"
    return plain(bank_lines(spark, sf_dir).groupBy("account").agg(F.count("*").alias("lines"), F.count_if(matched).alias("matched"), F.bool_and(matched).alias("complete")))


@query(f"""
WITH b AS ({BANKS}), r AS (SELECT account, min_by(2 * bank_amount - CASE WHEN status = 'F' THEN bank_amount ELSE 0 END + CASE WHEN status = 'F' THEN 0 ELSE bank_amount END, bank_id) AS opening, count(*) AS n FROM b GROUP BY account)
SELECT account AS source, CAST(opening AS DOUBLE) AS opening, n AS n_rows, CASE WHEN account % 5 > 0 THEN account % 20 END AS printed_rows, n = CASE WHEN account % 5 > 0 THEN account % 20 END AS agrees FROM r
""")
def opening_balances(spark, sf_dir):
    b = bank_lines(spark, sf_dir).withColumnRenamed("account", "source")
    money_in, money_out = (F.when(c, F.col("bank_amount")) for c in (F.col("status") == "F", F.col("status") != "F"))
    rows = b.select("source", F.col("bank_id").alias("sequence"), money_in.alias("money_in"), money_out.alias("money_out"), (F.col("bank_amount") * 2).cast("decimal(18,2)").alias("balance"))
    printed = b.select("source", (F.col("source") % 20).alias("printed_rows")).filter("source % 5 > 0").distinct()
    return plain(reviews.opening_balances(rows, printed))


@query("SELECT DISTINCT l_orderkey AS bank_id, l_partkey AS document, p_name AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'")
def approved_originals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bank_id"), F.col("l_partkey").alias("document"), (F.col("l_returnflag") == "A").alias("approved"))
    return plain(reviews.approved_originals(rows, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), F.col("p_name").alias("path"))))


@query("SELECT l_orderkey AS document, count(*) AS units, count(*) FILTER (l_linestatus <> 'F') AS unread, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY l_orderkey")
def extraction_coverage(spark, sf_dir):
    return plain(reviews.extraction_coverage(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_linestatus") == "F").alias("was_read"))))
