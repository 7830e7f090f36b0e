"""Queries of duplicates, proposals, groups, usage and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, duplicates, groups, proposals, routes, scoring, usage
from .standins import BANKS, PIECES, bank_lines, pieces, plain, query, table

HASH = "upper(sha256(text))"


@query(f"""
WITH h AS (SELECT doc_id, {HASH} AS sha256 FROM documents), g AS (SELECT sha256, count(*) AS copies FROM h GROUP BY sha256 HAVING count(*) > 1)
SELECT sha256, doc_id, copies, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS copy FROM h JOIN g USING (sha256)
""")
def exact_duplicates(spark, sf_dir):
    return plain(duplicates.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text").select("sha256", "doc_id", "copies", "copy"))


@query(f"""
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY {HASH})
SELECT CAST(sum(n) AS BIGINT) AS files, count(*) FILTER (n > 1) AS "groups", CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS copies, CAST(sum(n - 1) AS BIGINT) AS extra_copies, count(*) AS unique_documents FROM g
""")
def duplicate_summary(spark, sf_dir):
    return plain(duplicates.duplicate_summary(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"""
WITH h AS (SELECT {HASH} AS sha256, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT sha256, any_value(text) AS text, list_sort(list('src/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS paths FROM h GROUP BY sha256),
p AS (SELECT sha256, text, unnest(paths) AS path, unnest(range(0, len(paths))) AS copy FROM d)
SELECT sha256, path, copy, copy > 0 AS duplicate, unit_no, CAST(length(substr(text, unit_no * 12000 + 1, 12000)) AS BIGINT) AS n_chars
FROM (SELECT *, unnest(range(0, greatest(CAST(ceil(length(text) / 12000.0) AS BIGINT), 1))) AS unit_no FROM p)
""")
def inventory_rows(spark, sf_dir):
    from ..functions.text import text_parts

    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), "text")
    listed = docs.select(F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("id"), "path")
    once = docs.groupBy(F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("id")).agg(F.any_value("text").alias("text"))
    units = once.select("id", F.posexplode(text_parts(F.col("text"), 12_000)).alias("unit_no", "part"))
    rows = duplicates.inventory_rows(listed, units)
    return plain(rows.select(F.col("id").alias("sha256"), "path", "copy", "duplicate", "unit_no", F.length("part").alias("n_chars")))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unknown' END AS state
FROM documents d FULL JOIN (SELECT DISTINCT doc_id + 5 AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
""")
def source_drift(spark, sf_dir):
    present = table(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return plain(duplicates.source_drift(table(spark, sf_dir, "documents"), present, "doc_id"))


_REMOVED = f"removed AS (SELECT a.doc_id, min(b.doc_id) AS keeper FROM documents a JOIN documents b ON {HASH.replace('text', 'a.text')} = {HASH.replace('text', 'b.text')} AND b.doc_id < a.doc_id GROUP BY a.doc_id)"


def _removed(docs):
    hashed = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("keeper"))
    return hashed.join(first, "h").filter("doc_id != keeper").select("doc_id", "keeper")


@query(f"WITH {_REMOVED} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM removed)")
def unmatched_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return plain(duplicates.unmatched(docs.select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), _removed(docs), "doc_id"))


@query(f"""
WITH {_REMOVED}, r AS (SELECT doc_id, keeper FROM removed UNION ALL SELECT keeper, doc_id + 1 FROM removed WHERE doc_id % 5 = 0)
SELECT doc_id, 'two keepers' AS conflict FROM r GROUP BY doc_id HAVING count(DISTINCT keeper) > 1
UNION ALL SELECT DISTINCT keeper, 'keeper is removed' FROM r WHERE keeper IN (SELECT doc_id FROM r)
""")
def removal_conflicts(spark, sf_dir):
    removed = _removed(table(spark, sf_dir, "documents"))
    more = removed.filter("doc_id % 5 = 0").select(F.col("keeper").alias("doc_id"), (F.col("doc_id") + 1).alias("keeper"))
    return plain(duplicates.removal_conflicts(removed.unionByName(more), "doc_id", "keeper"))


#: Allocations: each piece supports the order it is printed on and, for returned ones, the order after that.
ALLOCATIONS = f"""
p AS ({PIECES}),
a AS (SELECT document AS bank_id, item_id, amount, CASE WHEN flag = 'R' THEN 'denied' ELSE 'approved' END AS status FROM p
      UNION ALL SELECT document + 1, item_id, CAST(0.5 * amount AS DECIMAL(18,2)), 'approved' FROM p WHERE flag = 'A')
"""


def allocations(items):
    own = items.select(F.col("document").alias("bank_id"), "item_id", "amount", F.when(F.col("flag") == "R", "denied").otherwise("approved").alias("status"))
    next_ = items.filter("flag = 'A'").select((F.col("document") + 1).alias("bank_id"), "item_id", (F.lit("0.5").cast("decimal(2,1)") * F.col("amount")).cast("decimal(18,2)").alias("amount"), F.lit("approved").alias("status"))
    return own.unionByName(next_)


@query(f"WITH {ALLOCATIONS} SELECT item_id, CAST(sum(amount) AS DOUBLE) AS used FROM a WHERE status = 'approved' GROUP BY item_id")
def reservations(spark, sf_dir):
    return plain(proposals.reservations(allocations(pieces(spark, sf_dir))))


@query(f"""
WITH {ALLOCATIONS}, u AS (SELECT item_id, sum(amount) AS used FROM a WHERE status = 'approved' GROUP BY item_id)
SELECT item_id, CAST(amount AS DOUBLE) AS amount, CAST(coalesce(used, 0) AS DOUBLE) AS used, CAST(amount - coalesce(used, 0) AS DOUBLE) AS remaining FROM p LEFT JOIN u USING (item_id)
""")
def remaining_capacity(spark, sf_dir):
    items = pieces(spark, sf_dir)
    return plain(proposals.remaining(items.select("item_id", "amount"), proposals.reservations(allocations(items))))


@query(f"""
WITH {ALLOCATIONS}, o AS (SELECT item_id FROM a GROUP BY item_id HAVING sum(amount) > (SELECT amount FROM p WHERE p.item_id = a.item_id)),
t AS (SELECT DISTINCT bank_id FROM a JOIN o USING (item_id))
SELECT bank_id, item_id, CAST(amount AS DOUBLE) AS amount, CASE WHEN bank_id IN (SELECT bank_id FROM t) THEN 'tentative' ELSE 'strong' END AS assessment FROM a
""".replace("GROUP BY item_id HAVING sum(amount) > (SELECT amount FROM p WHERE p.item_id = a.item_id)", "JOIN (SELECT item_id, amount AS capacity FROM p) USING (item_id) GROUP BY item_id, capacity HAVING sum(amount) > capacity"))
def over_allocation_guard(spark, sf_dir):
    items = pieces(spark, sf_dir)
    return plain(proposals.over_allocated(allocations(items).drop("status"), items.select("item_id", "amount")))


_RULES = f"""
WITH {ALLOCATIONS}, b AS ({BANKS}),
f AS (SELECT b.bank_id, max(bank_amount) AS bank_amount, count(item_id) AS n, coalesce(bool_or(a.bank_id <> document), false) AS unknown, coalesce(sum(a.amount), 0) AS total
      FROM b LEFT JOIN a USING (bank_id) LEFT JOIN (SELECT item_id, document FROM p) USING (item_id) GROUP BY b.bank_id)
"""


@query(_RULES + """SELECT bank_id, CASE WHEN n = 0 THEN 'not returned' WHEN unknown THEN 'unknown or repeated piece' WHEN total > bank_amount THEN 'exceeds the bank amount' WHEN total <> bank_amount THEN 'strong but incomplete' END AS failure FROM f""")
def allocation_rules(spark, sf_dir):
    items = pieces(spark, sf_dir).withColumn("currency", F.lit("MYR"))
    asked = allocations(items).drop("status").withColumn("assessment", F.lit("strong"))
    allowed = items.select(F.col("document").alias("bank_id"), "item_id")
    return plain(proposals.allocation_failures(asked, bank_lines(spark, sf_dir).withColumn("currency", F.lit("MYR")), items.select("item_id", "amount", "currency"), allowed))


_FACTS = f"""
WITH b AS ({BANKS}), p AS ({PIECES}),
f AS (SELECT bank_id, bank_amount, status, count(item_id) AS n, sum(amount) AS total, coalesce(bool_or(flag = 'R'), false) AS stale, bank_id % 11 = 0 AS failed, bank_id % 13 = 0 AS outdated, bank_id % 3 = 0 AS exact FROM b LEFT JOIN p ON document = bank_id GROUP BY bank_id, bank_amount, status)
"""


def _facts(spark, sf_dir):
    """A line's pieces; every third bank amount is taken to be the total, since real ones never agree here."""
    banks, items = bank_lines(spark, sf_dir), pieces(spark, sf_dir)
    rows = banks.join(items, banks["bank_id"] == items["document"], "left").groupBy("bank_id", "bank_amount", "status").agg(
        F.count("item_id").alias("n"), F.sum("amount").cast("decimal(18,2)").alias("total"), F.coalesce(F.bool_or(F.col("flag") == "R"), F.lit(False)).alias("stale")
    )
    exact = F.coalesce(F.when(F.col("bank_id") % 3 == 0, F.col("total")), F.col("bank_amount"))
    return rows.withColumn("bank_amount", exact).withColumn("failed", F.col("bank_id") % 11 == 0).withColumn("outdated", F.col("bank_id") % 13 == 0)


@query(_FACTS + """
SELECT bank_id, CASE WHEN failed THEN 'failed' WHEN outdated THEN 'outdated' WHEN n = 0 AND status = 'P' THEN 'unresolved' WHEN n = 0 THEN NULL WHEN stale THEN 'low' WHEN NOT exact AND total <> bank_amount THEN 'low' WHEN status = 'F' THEN 'high' ELSE 'low' END AS level FROM f
""")
def pairing_confidence(spark, sf_dir):
    assessment = F.when(F.col("status") == "F", "strong").when(F.col("status") == "P", "tentative").otherwise("none")
    facts = _facts(spark, sf_dir).withColumn("saved", F.lit(True)).withColumn("assessment", assessment).withColumn("changed", F.lit(False)).withColumn("boundary_unresolved", F.lit(False))
    return plain(proposals.pairing_confidence(facts).select("bank_id", "level"))


@query(_FACTS + """
SELECT bank_id, n AS pieces, CAST(CASE WHEN exact AND n > 0 THEN 0 ELSE bank_amount - coalesce(total, 0) END AS DOUBLE) AS difference,
       CASE WHEN status = 'F' AND NOT stale AND (CASE WHEN exact AND n > 0 THEN 0 ELSE bank_amount - coalesce(total, 0) END) = 0 AND n > 1 THEN 'supported' ELSE 'not supported' END AS support FROM f
""")
def support_report(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    difference = (F.col("bank_amount") - F.coalesce("total", F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)")
    decision = F.when(F.col("status") == "F", "approved").otherwise("denied")
    return plain(facts.select("bank_id", F.col("n").alias("pieces"), difference.alias("difference"), proposals.support_status(decision, F.col("stale"), difference, F.col("n") <= 1).alias("support")))


@query(f"""
WITH b AS ({BANKS}), p AS ({PIECES}), c AS (SELECT bank_id, item_id, bank_amount - amount AS d FROM b JOIN p ON abs(bank_amount - amount) <= 0.05),
n AS (SELECT *, count(*) OVER (PARTITION BY bank_id) AS x, count(*) OVER (PARTITION BY item_id) AS y FROM c)
SELECT bank_id, item_id, CAST(d AS DOUBLE) AS difference FROM n WHERE x = 1 AND y = 1
""")
def fastlane_proposals(spark, sf_dir):
    pairs = routes.amount_alone(bank_lines(spark, sf_dir), pieces(spark, sf_dir))
    return plain(pairs.select("bank_id", "item_id", "difference"))


@query(f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY item_id) AS k, count(*) OVER (PARTITION BY document) AS n FROM ({PIECES})),
t AS (SELECT document, sum(amount) FILTER (k <= 3) AS target FROM p WHERE n BETWEEN 2 AND 12 GROUP BY document),
s(document, k, items, total, m) AS (
  SELECT document, k, item_id, amount, 1 FROM p JOIN t USING (document)
  UNION ALL SELECT s.document, p.k, s.items || '|' || p.item_id, CAST(s.total + p.amount AS DECIMAL(18,2)), s.m + 1 FROM s JOIN p ON p.document = s.document AND p.k > s.k)
SELECT s.document AS bank_id, items, CAST(total AS DOUBLE) AS total FROM s JOIN t USING (document) WHERE m >= 2 AND total = target
""")
def subset_sum_groups(spark, sf_dir):
    from pyspark.sql.window import Window

    items = pieces(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("document").orderBy("item_id")))
    target = items.groupBy("document").agg(F.sum(F.when(F.col("k") <= 3, F.col("amount"))).cast("decimal(18,2)").alias("bank_amount"))
    members = items.join(target, "document").select(F.col("document").alias("bank_id"), "bank_amount", F.col("document").alias("claim_group"), "item_id", "amount")
    return plain(groups.exact_subsets(members).select("bank_id", F.array_join("items", "|").alias("items"), "total"))


#: Lines compete for pieces of the same amount.
_TOP = "c AS (SELECT DISTINCT l_orderkey AS bank_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS item_id FROM lineitem)"


def _choices(spark, sf_dir):
    item = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bank_id"), item.alias("item_id"), F.lit(1).alias("rank")).distinct()


@query(f"""
WITH RECURSIVE {_TOP}, o AS (SELECT item_id, min(bank_id) AS owner FROM c GROUP BY item_id),
e AS (SELECT bank_id AS u, owner AS v FROM c JOIN o USING (item_id) UNION SELECT owner, bank_id FROM c JOIN o USING (item_id)),
r(n, root) AS (SELECT bank_id, bank_id FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.n)
SELECT n AS bank_id, min(root) AS component FROM r GROUP BY n
""")
def competition_components(spark, sf_dir):
    choices = _choices(spark, sf_dir)
    return plain(groups.components(choices.select("bank_id").distinct(), groups.first_owner(choices)))


@query()
def batch_packing(spark, sf_dir):
    choices = _choices(spark, sf_dir)
    grouped = groups.components(choices.select("bank_id").distinct(), groups.first_owner(choices))
    best = choices.groupBy("bank_id").agg(F.min("item_id").alias("best"))
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bank_id"), (F.col("l_partkey") % 300).alias("document")).distinct()
    lines = grouped.join(best, "bank_id").withColumn("chars", (F.col("bank_id") % 5000 + 200).cast("bigint"))
    return plain(batches.affine_batches(lines, wanted, wanted.select("document").distinct().withColumn("chars", 500 + 20 * F.col("document"))))


_SEGMENTS = "CAST(('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 6)) AS BIGINT) % 64 = 0"


@query(f"""
WITH RECURSIVE {_TOP}, o AS (SELECT item_id, min(bank_id) AS owner FROM c GROUP BY item_id),
e AS (SELECT bank_id AS u, owner AS v FROM c JOIN o USING (item_id) UNION SELECT owner, bank_id FROM c JOIN o USING (item_id)),
r(n, root) AS (SELECT bank_id, bank_id FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.n),
l AS (SELECT n AS bank_id, min(root) AS component FROM r GROUP BY n),
x AS (SELECT component, count(*) AS n FROM l GROUP BY component),
g AS (SELECT component, n, coalesce(CAST(last_value(CASE WHEN {_SEGMENTS.format("component")} THEN component END IGNORE NULLS) OVER (ORDER BY component) AS VARCHAR), '') AS segment FROM x WHERE n <= 3),
p AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY component) AS pos FROM g),
f(segment, pos, component, used, k) AS (
  SELECT segment, pos, component, n, 0 FROM p WHERE pos = 1
  UNION ALL SELECT p.segment, p.pos, p.component, CASE WHEN used + p.n > 3 THEN p.n ELSE used + p.n END, CASE WHEN used + p.n > 3 THEN k + 1 ELSE k END FROM f JOIN p ON p.segment = f.segment AND p.pos = f.pos + 1)
SELECT l.bank_id, l.component, f.segment || '-' || k AS batch FROM l JOIN f USING (component)
UNION ALL SELECT bank_id, component, component || '/' || ((row_number() OVER (PARTITION BY component ORDER BY bank_id) - 1) // 3) FROM l JOIN x USING (component) WHERE n > 3
""")
def connected_batches(spark, sf_dir):
    choices = _choices(spark, sf_dir)
    return plain(batches.connected_batches(groups.components(choices.select("bank_id").distinct(), groups.first_owner(choices)), 3))


@query(f"""
WITH RECURSIVE p AS ({PIECES}), g AS (
  SELECT document, line AS page, CAST(sum(CAST(amount * 100 AS BIGINT) % 60000) AS BIGINT) AS chars, CAST(sum(part % 25) AS BIGINT) AS images, bool_or(part % 31 = 0) AS blocked, row_number() OVER (PARTITION BY document ORDER BY line) AS pos
  FROM p GROUP BY document, line),
s(document, pos, page, request, asked, n, c, i, broken) AS (
  SELECT document, 0::BIGINT, 0::BIGINT, NULL::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM (SELECT DISTINCT document FROM g)
  UNION ALL SELECT document, pos, page, CASE WHEN NOT bad THEN asked + fresh END, CASE WHEN bad THEN asked ELSE asked + fresh END, CASE WHEN bad THEN n WHEN fresh = 1 THEN 1 ELSE n + 1 END,
    CASE WHEN bad THEN c WHEN fresh = 1 THEN 500 + chars ELSE c + chars END, CASE WHEN bad THEN i WHEN fresh = 1 THEN images ELSE i + images END, bad
  FROM (SELECT g.document, g.pos, g.page, g.chars, g.images, s.asked, s.n, s.c, s.i, g.blocked OR g.chars + 500 > 50000 OR g.images > 30 AS bad,
      CASE WHEN s.broken OR s.n + 1 > 3 OR s.c + g.chars > 50000 OR s.i + g.images > 30 THEN 1 ELSE 0 END AS fresh FROM s JOIN g ON g.document = s.document AND g.pos = s.pos + 1))
SELECT document, page, request FROM s WHERE pos > 0
""")
def request_groups(spark, sf_dir):
    p = pieces(spark, sf_dir)
    units = p.select("document", F.col("line").alias("page"), ((F.col("amount") * 100).cast("bigint") % 60000).alias("chars"), (F.col("part") % 25).alias("images"), (F.col("part") % 31 == 0).alias("blocked"))
    return plain(batches.bounded_requests(units, pages=3, images=30, chars=50_000, overhead=500))


_ATTEMPTS = """
e AS (SELECT user_id || '-' || json_extract_string(props, '$.k') AS attempt, event_id, event_type, user_id % 3 AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY event_type = 'purchase' DESC, event_type IN ('purchase', 'click') DESC, event_id DESC) AS rn FROM e),
best AS (SELECT * EXCLUDE (rn) FROM n WHERE rn = 1)
"""


def attempts(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), k).alias("attempt"), "event_id", "event_type", (F.col("user_id") % 3).alias("model"), k.cast("bigint").alias("tokens"), (F.col("value").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"))
    return usage.best_attempts(rows, "attempt", F.col("event_type") == "purchase", F.col("event_type").isin("purchase", "click"), ["event_id"])


@query(f"WITH {_ATTEMPTS} SELECT * FROM best")
def usage_dedupe(spark, sf_dir):
    return plain(attempts(spark, sf_dir))


@query(f"""
WITH {_ATTEMPTS} SELECT event_type, model, count(*) AS attempts, count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS unknown, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents
FROM best GROUP BY GROUPING SETS ((event_type), (model), ())
""")
def usage_rollup(spark, sf_dir):
    return plain(usage.usage_rollup(attempts(spark, sf_dir), "event_type", "model", ["tokens", "cents"], ~F.col("event_type").isin("purchase", "click")))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 300 SECOND OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS ended, count(*) AS n FROM i GROUP BY user_id, session
""")
def sessions(spark, sf_dir):
    rows = usage.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("bigint").alias(c)
    return plain(rows.select("user_id", seconds("started"), seconds("ended"), "n"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n_calls, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) FILTER (k = (9 * n + 9) // 10) AS p90, max(value) AS max FROM r GROUP BY event_type
""")
def latency_stats(spark, sf_dir):
    rows = usage.latency_stats(table(spark, sf_dir, "events"), "event_type", "value")
    return plain(rows.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6)))


_STRATEGIES = "s AS (SELECT doc_id, 'quality' AS strategy, CASE quality WHEN 1 THEN 'strong' ELSE 'none' END AS assessment FROM labels UNION ALL SELECT doc_id, 'toxic', CASE toxic WHEN 0 THEN 'strong' ELSE 'none' END FROM labels)"


def strategies(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    one = lambda name, good: rows.select("doc_id", F.lit(name).alias("strategy"), F.when(F.col(name) == good, "strong").otherwise("none").alias("assessment"))
    return one("quality", 1).unionByName(one("toxic", 0))


@query(f"WITH {_STRATEGIES} SELECT doc_id, max(assessment) FILTER (strategy = 'quality') AS quality, max(assessment) FILTER (strategy = 'toxic') AS toxic FROM s GROUP BY doc_id")
def strategy_pivot(spark, sf_dir):
    return plain(scoring.strategy_pivot(strategies(spark, sf_dir), "doc_id", "strategy", "assessment", ["quality", "toxic"]))


@query(f"WITH {_STRATEGIES} SELECT doc_id, count(DISTINCT assessment) AS variants, count(*) AS strategies FROM s GROUP BY doc_id")
def agreement(spark, sf_dir):
    signed = scoring.signature(strategies(spark, sf_dir), ["doc_id", "strategy"], "assessment", "assessment")
    return plain(scoring.agreement(signed, "doc_id"))


@query("""
WITH x AS (SELECT doc_id % 50 AS k, doc_id FROM labels WHERE quality = 1), v AS (SELECT DISTINCT doc_id % 50 AS k, doc_id FROM documents WHERE n_chars > 300)
SELECT count(*) AS keys, count(*) FILTER (complete) AS complete FROM (SELECT x.k, bool_and(v.doc_id IS NOT NULL) AS complete FROM x LEFT JOIN v ON v.k = x.k AND v.doc_id = x.doc_id GROUP BY x.k)
""")
def retrieval_recall(spark, sf_dir):
    key = (F.col("doc_id") % 50).alias("k")
    expected = table(spark, sf_dir, "labels").filter("quality = 1").select(key, "doc_id")
    return plain(scoring.recall(expected, table(spark, sf_dir, "documents").filter("n_chars > 300").select(key, "doc_id"), "k", "doc_id"))


@query(r"""
WITH d AS (SELECT lang, source, unnest(string_split(text, ' ')) AS w FROM documents),
l AS (SELECT lang, w, count(*) AS l FROM d WHERE source = 'src1' GROUP BY lang, w), r AS (SELECT lang, w, count(*) AS r FROM d WHERE source = 'src2' GROUP BY lang, w)
SELECT lang, CAST(sum(least(coalesce(l, 0), coalesce(r, 0))) AS BIGINT) AS shared, CAST(sum(coalesce(l, 0)) AS BIGINT) AS n_left, CAST(sum(coalesce(r, 0)) AS BIGINT) AS n_right FROM l FULL JOIN r USING (lang, w) GROUP BY lang
""")
def multiset_overlap(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.split("text", " ")).alias("w"))
    return plain(scoring.multiset_overlap(words.filter("source = 'src1'"), words.filter("source = 'src2'"), "lang", "w"))
