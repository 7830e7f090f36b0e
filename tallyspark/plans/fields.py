"""Queries of column functions, retrieval cuts, statement checks, scores and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as T
from ..operators import groups, ledger, proposals, routes, scoring, usage
from ..operators.cut import spread
from ..sources import files, statements
from .standins import BANKS, PIECES, bank_lines, pieces, plain, query, table


@query("""
SELECT o_orderkey AS bank_id, o_orderkey AS item_id, 'inv' || o_orderkey || 'z' AS ref FROM orders WHERE o_orderkey % 4 IN (0, 1)
""")
def narrated_references(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("INV"), k.cast("string"), F.lit("Z"))
    spaced = F.regexp_replace(ref, "(.)", "$1 ")
    text = F.when(k % 4 == 0, F.concat(F.lit("Transfer "), spaced, F.lit("thanks"))).when(k % 4 == 1, F.concat(F.lit("paid ("), ref, F.lit("):now"))).when(k % 4 == 2, F.concat(F.lit("x"), ref)).otherwise(F.concat(ref, F.lit("-2")))
    o = table(spark, sf_dir, "orders")
    return plain(routes.narrated_references(o.select(k.alias("bank_id"), text.alias("narration")), o.select(k.alias("item_id"), F.array(T.normalize_reference(ref)).alias("refs"))))


@query("""
WITH d AS (SELECT DISTINCT 1990 + l_suppkey % 20 AS y, 1 + l_linenumber % 12 AS m, 1 + l_partkey % 33 AS d FROM lineitem), t AS (SELECT y || '-' || m || '-' || d AS text FROM d)
SELECT text, CASE WHEN TRY_CAST(text AS DATE) IS NULL THEN 'pay ' || text || ' x' ELSE 'pay   x' END AS blanked FROM t
""")
def blanked_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", 1990 + F.col("l_suppkey") % 20, 1 + F.col("l_linenumber") % 12, 1 + F.col("l_partkey") % 33).alias("text")).distinct()
    return plain(rows.withColumn("blanked", T.blank_dates(F.concat(F.lit("pay "), "text", F.lit(" x")))))


@query("SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderkey % 4 AS form FROM orders")
def parsed_dates(spark, sf_dir):
    d, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = F.when(form == 0, F.date_format(d, "yyyy-M-d")).when(form == 1, F.date_format(d, "d MMM yyyy")).when(form == 2, F.concat(F.date_format(d, "d "), F.date_format(d, "MMMM"), F.date_format(d, " yyyy"))).otherwise(F.date_format(d, "yyyy年M月d日"))
    # A full name of three letters (May) has the short form's spelling.
    return plain(table(spark, sf_dir, "orders").select(T.parse_date(text).alias("date"), form.alias("form")).distinct())


_NAMES = r"""
n AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+')[1:4] AS a, regexp_extract_all(lower(text), '[a-z]+')[2:5] AS b FROM documents WHERE lang = 'en' AND text IS NOT NULL),
t AS (SELECT doc_id, list_filter(list_distinct(a), lambda x: NOT list_contains(['sdn','bhd','the','bank','myr','cik','puan','encik','bin','binti','bt','bint','berhad'], x)) AS a, list_filter(list_distinct(b), lambda x: NOT list_contains(['sdn','bhd','the','bank','myr','cik','puan','encik','bin','binti','bt','bint','berhad'], x)) AS b FROM n),
s AS (SELECT *, len(list_intersect(a, b)) AS k, least(len(a), len(b)) AS short FROM t)
"""


@query(f"""
WITH {_NAMES}
SELECT doc_id, short > 0 AND ((len(a) = len(b) AND k = len(a)) OR (k >= 2 AND k >= 0.8 * short) OR array_to_string(list_sort(a), '') = array_to_string(list_sort(b), '')) AS same FROM s
""")
def same_names(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = table(spark, sf_dir, "documents").filter("lang = 'en' and text is not null").select("doc_id", F.array_join(F.slice(words, 1, 4), " ").alias("a"), F.array_join(F.slice(words, 2, 4), " ").alias("b"))
    return plain(rows.select("doc_id", T.same_name(F.col("a"), F.col("b")).alias("same")))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS truncated FROM customer")
def truncated_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    cut = F.when(F.col("c_custkey") % 3 == 0, "Jon Abdullah Sulai").when(F.col("c_custkey") % 3 == 1, "Jon Abdullah Sul").otherwise("Jon Hamid Sulai")
    return plain(rows.select("c_custkey", T.truncated_name(cut, F.lit("JON BIN ABDULLAH SULAIMAN")).alias("truncated")))


@query(r"""
WITH t AS (SELECT doc_id, substr(text, 1, 30) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, t, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '[0-9]')) AS digits FROM t)
SELECT doc_id, letters >= 2 AND digits * 3 <= letters AND NOT regexp_matches(t, '[0-9]{5,}') AND NOT regexp_matches(t, '(?i)\.TXT\b') AS plausible FROM c
""")
def plausible_parties(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return plain(rows.select("doc_id", T.plausible_party(F.substring("text", 1, 30)).alias("plausible")))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'inv-' || (1000 + o_orderkey) WHEN 1 THEN 'ab' || (1000 + o_orderkey) WHEN 2 THEN (1000 + o_orderkey) || 'x' END AS labelled, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || (1000 + o_orderkey) END AS typed FROM orders
""")
def references(spark, sf_dir):
    k = F.col("o_orderkey")
    number = (1000 + k).cast("string")
    kind = k % 6
    text = F.when(kind == 0, F.concat(F.lit("INV-"), number)).when(kind == 1, F.concat(F.lit("Invoice No.: AB "), number)).when(kind == 2, F.concat(F.lit("receipt # "), number, F.lit("X"))).when(kind == 3, F.concat(F.lit("shipment: "), number)).when(kind == 4, F.lit("invoice: abcd")).otherwise(number)
    typed = T.typed_reference(F.when(k % 2 == 0, "Invoice_Number").otherwise("tracking"), F.concat(F.lit("R "), number))
    return plain(table(spark, sf_dir, "orders").select("o_orderkey", T.labelled_reference(text).alias("labelled"), typed.alias("typed")))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TNB' WHEN 1 THEN 'My TNB and EPF' WHEN 2 THEN 'TNBX' ELSE '' END AS name FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TNB|TENAGA NASIONAL BERHAD' WHEN 1 THEN 'My TNB and EPF|KUMPULAN WANG SIMPANAN PEKERJA|TENAGA NASIONAL BERHAD' WHEN 2 THEN 'TNBX' ELSE '' END AS names FROM t
""")
def aliased_names(spark, sf_dir):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "TNB").when(k == 1, "My TNB and EPF").when(k == 2, "TNBX").otherwise("")
    return plain(table(spark, sf_dir, "customer").select("c_custkey", F.array_join(routes.with_aliases(F.array(name)), "|").alias("names")))


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, CAST(greatest(least(CAST(l_extendedprice AS DECIMAL(18,2)) - 20000, CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS allocation, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS DOUBLE) END AS number FROM lineitem
""")
def amounts_of_pieces(spark, sf_dir):
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise("n/a")
    return plain(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.cents(amount).alias("cents"), M.default_allocation((amount - 20000).cast("decimal(18,2)"), amount).alias("allocation"), M.number(text).alias("number")))


@query("""
SELECT a.flag || '/' || b.flag AS pair, CASE WHEN a.code IS NULL OR b.code IS NULL THEN TRUE ELSE a.code = b.code END AS agree
FROM (SELECT DISTINCT l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 'MYR' WHEN 'N' THEN 'USD' END AS code FROM lineitem) a, (SELECT DISTINCT l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 'MYR' WHEN 'N' THEN 'MYR' END AS code FROM lineitem) b
""")
def agreeing_currencies(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    code = lambda n: F.when(F.col("l_returnflag") == "A", " myr").when(F.col("l_returnflag") == "N", n).otherwise("")
    left, right = flags.select(F.col("l_returnflag").alias("a"), code("usd").alias("x")), flags.select(F.col("l_returnflag").alias("b"), code("RM").alias("y"))
    return plain(left.crossJoin(F.broadcast(right)).select(F.concat_ws("/", "a", "b").alias("pair"), M.currencies_agree(F.col("x"), F.col("y")).alias("agree")))  # three flags


@query(f"WITH p AS ({PIECES}) SELECT item_id FROM p WHERE line % 3 <> 0 AND supplier % 4 <> 0")
def live_pieces(spark, sf_dir):
    p = pieces(spark, sf_dir).withColumn("excluded", F.when(F.col("line") % 3 == 0, True)).withColumn("retired", F.col("supplier") % 4 == 0)
    return plain(routes.live(p).select("item_id"))


@query(f"""
WITH p AS ({PIECES}), e AS (SELECT DISTINCT document AS bank_id, part AS item_id FROM p), r AS (SELECT DISTINCT document AS bank_id, CASE WHEN line = 7 THEN -part ELSE part END AS item_id, line = 7 AS named FROM p WHERE line <= 2 OR line = 7),
c AS (SELECT bank_id, count(*) AS selected, count(*) FILTER (named) AS by_name FROM r GROUP BY bank_id), n AS (SELECT bank_id, count(*) AS pool FROM e GROUP BY bank_id)
SELECT b.bank_id, coalesce(selected, 0) AS selected, coalesce(pool, 0) + coalesce(by_name, 0) AS eligible, coalesce(pool, 0) - coalesce(selected - by_name, 0) AS omitted, coalesce(pool, 0) > coalesce(selected - by_name, 0) AS search_incomplete
FROM ({BANKS}) b LEFT JOIN c USING (bank_id) LEFT JOIN n USING (bank_id)
""")
def search_audit(spark, sf_dir):
    p = pieces(spark, sf_dir).select(F.col("document").alias("bank_id"), F.col("part").alias("item_id"), "line")
    named = F.col("line") == 7
    ranked = p.filter("line <= 2 or line = 7").select("bank_id", F.when(named, -F.col("item_id")).otherwise(F.col("item_id")).alias("item_id"), F.when(named, "found by filename").otherwise("amount").alias("route")).distinct()
    return plain(routes.search_audit(ranked, p, bank_lines(spark, sf_dir)))


@query("""
WITH p AS (SELECT l_suppkey AS bank_id, l_linenumber AS place, l_partkey AS item_id, min(l_quantity) AS pos FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY bank_id, item_id ORDER BY place, pos) AS n FROM p), g AS (SELECT bank_id, place, item_id, pos FROM f WHERE n = 1),
c AS (SELECT *, coalesce(count(*) OVER (PARTITION BY bank_id ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT bank_id, place, count(*) AS items FROM c WHERE before < 30 GROUP BY bank_id, place
""")
def content_slots(spark, sf_dir):
    placed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("bank_id"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("item_id")).agg(F.min("l_quantity").alias("pos"))
    return plain(routes.content_slots(placed).groupBy("bank_id", "place").agg(F.count("*").alias("items")))


_FACTS = "l_suppkey AS bank_id, l_partkey AS item_id, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) = 1 AS has_ref, max(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) = 1 AS name, max(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) = 1 AS amount, CAST(max(l_quantity) AS INTEGER) % 7 AS score, min(l_orderkey) % 50 AS gap, l_partkey % 9 = 0 AS conflict"


@query(f"""
WITH r AS (SELECT {_FACTS} FROM lineitem GROUP BY l_suppkey, l_partkey), k AS (SELECT *, row_number() OVER w AS o, count(*) FILTER (name AND NOT conflict) OVER w AS nn, count(*) FILTER (amount AND NOT conflict) OVER w AS na FROM r WHERE has_ref OR NOT conflict WINDOW w AS (PARTITION BY bank_id ORDER BY has_ref DESC, score DESC, gap, item_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, has_ref OR (name AND NOT conflict AND nn <= 20) OR (amount AND NOT conflict AND na <= 20) AS p FROM k),
c AS (SELECT *, count(*) FILTER (p) OVER (PARTITION BY bank_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS np, least(count(*) FILTER (p) OVER (PARTITION BY bank_id), 40) AS all_p, count(*) FILTER (NOT p AND score > 0 AND NOT conflict) OVER (PARTITION BY bank_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS nt FROM m)
SELECT bank_id, item_id, p AS "primary" FROM c WHERE (p AND np <= 40) OR (NOT p AND score > 0 AND NOT conflict AND nt <= greatest(10 - all_p, 0))
""")
def retrieval_slots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bank_id"), F.col("l_partkey").alias("item_id"), "l_quantity", "l_linenumber", "l_orderkey")
    facts = spread(lines, "bank_id").groupBy("bank_id", "item_id").agg(
        (F.max("l_quantity") > 45).alias("has_ref"), F.bool_or(F.col("l_linenumber") % 2 == 0).alias("name"), F.bool_or(F.col("l_linenumber") % 3 == 0).alias("amount"), (F.max("l_quantity").cast("int") % 7).alias("score"), (F.min("l_orderkey") % 50).alias("gap"), (F.col("item_id") % 9 == 0).alias("conflict")
    )
    return plain(routes.retrieval_slots(facts).select("bank_id", "item_id", "primary"))


@query("""
SELECT o_orderkey AS bank_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'tentative' WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN 'tentative' WHEN o_orderkey % 3 = 0 THEN 'strong' WHEN o_orderkey % 3 = 1 THEN 'none' ELSE 'tentative' END AS assessment FROM orders
""")
def softened(spark, sf_dir):
    k = F.col("bank_id")
    rows = bank_lines(spark, sf_dir).select("bank_id", F.when(k % 3 == 0, "strong").when(k % 3 == 1, "none").otherwise("tentative").alias("assessment"), F.when(k % 4 == 0, F.array(F.lit("found by filename"))).otherwise(F.array(F.lit("amount"), F.lit("found by filename"))).alias("routes"), (k % 5 == 0).alias("search_incomplete"))
    return plain(proposals.soften(rows).select("bank_id", "assessment"))


@query("""
WITH r AS (SELECT l_suppkey AS statement, l_orderkey, l_linenumber, l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS i, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS o, max(l_quantity) > 49 AS bad FROM lineitem GROUP BY 1, 2, 3, 4),
t AS (SELECT statement, sum(i) AS ti, sum(o) AS tou FROM r GROUP BY statement)
SELECT statement, 'money in' AS "check" FROM t WHERE statement % 3 = 0 UNION ALL SELECT statement, 'money out' FROM t WHERE statement % 5 = 0 UNION ALL SELECT statement, 'closing balance' FROM t WHERE statement % 7 = 0
UNION ALL SELECT DISTINCT statement, 'one positive side' FROM r WHERE NOT ((i > 0) <> (o > 0))
""")
def statement_violations(spark, sf_dir):
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    keys = [F.col("l_suppkey").alias("statement"), "l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum(F.when(F.col("l_returnflag") == "R", amount).otherwise(0)).cast("decimal(18,2)").alias("money_in"), F.sum(F.when(F.col("l_returnflag") != "R", amount).otherwise(0)).cast("decimal(18,2)").alias("money_out"))
    rows = rows.withColumn("opening", F.lit(0).cast("decimal(18,2)"))
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = ledger.running_balance(rows, "statement", order).withColumnRenamed("calculated", "balance")
    s = F.col("statement")
    printed = rows.groupBy("statement").agg(F.sum("money_in").alias("i"), F.sum("money_out").alias("o")).select("statement", (F.col("i") - F.col("o") + (s % 7 == 0).cast("int")).alias("closing"), (F.col("i") + (s % 3 == 0).cast("int")).alias("printed_in"), (F.col("o") + (s % 5 == 0).cast("int")).alias("printed_out"))
    return plain(ledger.validate_statement(rows, printed, "statement", order))


@query("""
SELECT l_orderkey AS document, CASE WHEN count(l_partkey) FILTER (l_quantity > 40) = 0 THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) END AS amount, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS currency, count(*) AS n FROM lineitem GROUP BY l_orderkey
""")
def merged_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.when(F.col("l_quantity") <= 40, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.col("l_returnflag").alias("currency"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("text"))
    return plain(groups.merged_entries(rows, ["document"]).drop("text"))


@query("""
WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'e' || o_custkey END AS e FROM orders), k AS (SELECT CASE WHEN e = '' THEN CAST(id AS VARCHAR) ELSE e END AS bundle, id FROM d)
SELECT bundle, CAST(min(id) AS VARCHAR) AS id, count(*) AS documents FROM k GROUP BY bundle
""")
def bundled_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("e"), "o_custkey")).alias("expense_id"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("amount"))
    return plain(groups.bundled(o).select("bundle", "id", F.size("document_ids").alias("documents")))


@query("""
SELECT l_orderkey AS bank_id, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR))))[1] AS evidence_1, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR))))[2] AS evidence_2, greatest(count(DISTINCT l_partkey) - 2, 0) AS rest FROM lineitem GROUP BY l_orderkey
""")
def evidence_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bank_id"), F.col("l_partkey").cast("string").alias("path"))
    return plain(files.evidence_columns(rows, "bank_id", 2))


@query("""
SELECT count(*) FILTER (o_orderkey % 6 IN (0, 1)) AS correct, count(*) FILTER (o_orderkey % 6 = 2) AS safe, count(*) FILTER (o_orderkey % 6 IN (3, 4)) AS unsafe, count(*) FILTER (o_orderkey % 6 = 5) AS missing FROM orders
""")
def decision_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    truth = o.select(k.alias("bank_id"), F.array(k).alias("truth_items"))
    made = o.filter(k % 6 != 5).select(k.alias("bank_id"), F.when(k % 6 == 2, "tentative").otherwise("strong").alias("assessment"), F.array(F.when(k % 6 >= 3, -1).otherwise(k)).alias("items"))
    return plain(scoring.decision_scores(truth, made, "bank_id"))


@query("SELECT level, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('none')) v(level) LEFT JOIN orders ON o_orderstatus = level GROUP BY level")
def level_counts(spark, sf_dir):
    return plain(scoring.level_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("level")), "level", ["F", "O", "P", "none"]))


@query("""
WITH p AS (SELECT l_suppkey % 5 AS a, l_partkey % 7 AS b FROM lineitem)
SELECT 'r/' || a AS folder, count(*) AS n FROM p GROUP BY a UNION ALL SELECT 'r/' || a || '/' || b, count(*) FROM p GROUP BY a, b UNION ALL SELECT 'r', count(*) FROM p
""")
def folder_counts(spark, sf_dir):
    path = F.concat_ws("/", F.lit("r"), F.col("l_suppkey") % 5, F.col("l_partkey") % 7, "l_orderkey")
    return plain(scoring.path_rollup(table(spark, sf_dir, "lineitem").select(path.alias("path")), "path"))


@query("""
SELECT event_type, epoch(max(ts) FILTER (user_id % 9 <> 0)) - epoch(min(ts)) AS seconds, count(*) FILTER (user_id % 9 = 0) AS open FROM events GROUP BY event_type
""")
def wall_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", F.when(F.col("user_id") % 9 != 0, F.col("ts")).alias("end"))
    return plain(usage.wall_span(rows, "event_type", "ts", "end"))


@query("SELECT event_type, sum(user_id * 0.25 * CASE WHEN user_id >= 50 THEN 2.0 ELSE 1.0 END) FILTER (user_id % 4 <> 0) AS cost, count(*) FILTER (user_id % 4 = 0) AS unpriced FROM events GROUP BY event_type")
def usage_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.when(F.col("user_id") % 4 != 0, 0.25).alias("price"))
    return plain(usage.cost(rows, "event_type", "user_id", "price", 50, 2.0))


@query("""
SELECT doc_id AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0
""")
def changed_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), F.lit(1).alias("modified"))
    known = docs.filter("path % 3 != 0").withColumn("bytes", F.when(F.col("path") % 5 == 0, -1).otherwise(F.col("bytes")))
    return plain(files.changed_files(docs, known).select("path"))


@query("""
WITH r AS (SELECT DISTINCT l_suppkey AS source, 'layout ' || l_linenumber AS layout, FALSE AS x FROM lineitem), p AS (SELECT source, layout, (source + CAST(right(layout, 1) AS INTEGER)) % 4 = 0 AS passed FROM r)
SELECT source, CASE WHEN count(*) FILTER (passed) = 1 THEN max(layout) FILTER (passed) END AS layout, CASE WHEN count(*) FILTER (passed) = 0 THEN 'no layout passes' WHEN count(*) FILTER (passed) > 1 THEN 'several layouts pass' END AS error FROM p GROUP BY source
""")
def passing_layouts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat(F.lit("layout "), "l_linenumber").alias("layout"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 4 == 0).alias("passed")).distinct()
    return plain(statements.one_passing_layout(rows))


_WORDS = "l_orderkey AS source, 1 AS page, l_linenumber AS line, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_returnflag AS flag"


@query(f"""
WITH w AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) {_WORDS} FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice),
l AS (SELECT *, CASE WHEN flag = 'R' THEN amount END AS money, last_value(CASE WHEN line % 2 = 1 THEN date END IGNORE NULLS) OVER (PARTITION BY source ORDER BY line) AS d, sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line) AS grp FROM w)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY grp) AS sequence, arg_min_null(d, line) AS date_text, string_agg('note' || line, chr(10) ORDER BY line) AS narration, CAST(max(money) AS DOUBLE) AS money_in FROM l WHERE grp > 0 GROUP BY source, grp
""")
def statement_rows(spark, sf_dir):
    from pyspark.sql.window import Window

    amount, date = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_shipdate").cast("date").cast("string")
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").withColumn("n", first).filter("n = 1")
    printed = F.array_compact(F.array(F.when(F.col("l_linenumber") % 2 == 1, F.struct(F.lit(5.0).alias("x"), date.alias("text"))), F.struct(F.lit(50.0).alias("x"), F.concat(F.lit("note"), "l_linenumber").alias("text")), F.when(F.col("l_returnflag") == "R", F.struct(F.lit(150.0).alias("x"), amount.alias("text")))))
    words = rows.select(F.col("l_orderkey").alias("source"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), F.explode(printed).alias("w")).select("source", "page", "line", "w.*")
    layout = statements.Layout("plain", {"date": (0, 40), "narration": (40, 120), "money_in": (120, 200)})
    return plain(statements.statement_rows(words, layout).select("source", "sequence", "date_text", "narration", "money_in"))
