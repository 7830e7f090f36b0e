"""Queries of the statement controls and of money columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..operators import ledger
from .standins import BANKS, bank_lines, plain, query, table

#: A statement is a customer's orders; status O goes out, the rest comes in; every seventh printed balance is off by one.
LEDGER = f"""
l AS (SELECT *, CASE WHEN status = 'O' THEN 0 ELSE bank_amount END AS money_in, CASE WHEN status = 'O' THEN bank_amount ELSE 0 END AS money_out FROM ({BANKS})),
r AS (SELECT *, CAST(100 + sum(money_in - money_out) OVER (PARTITION BY account ORDER BY bank_date, bank_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS calculated FROM l)
"""


def ledger_rows(spark, sf_dir):
    b = bank_lines(spark, sf_dir)
    zero = F.lit(0).cast("decimal(18,2)")
    out = F.col("status") == "O"
    return b.withColumn("money_in", F.when(out, zero).otherwise(F.col("bank_amount"))).withColumn("money_out", F.when(out, F.col("bank_amount")).otherwise(zero)).withColumn("opening", F.lit(100).cast("decimal(18,2)"))


@query(f"WITH {LEDGER} SELECT account, bank_id, CAST(calculated AS DOUBLE) AS calculated FROM r")
def running_balance(spark, sf_dir):
    return plain(ledger.running_balance(ledger_rows(spark, sf_dir), "account", ["bank_date", "bank_id"]).select("account", "bank_id", "calculated"))


@query(f"""
WITH {LEDGER}, w AS (SELECT *, calculated + 1 AS balance FROM r WHERE bank_id % 7 = 0)
SELECT account, min_by(bank_id, struct_pack(d := bank_date, i := bank_id)) AS bank_id, CAST(min_by(balance, struct_pack(d := bank_date, i := bank_id)) AS DOUBLE) AS balance, CAST(min_by(calculated, struct_pack(d := bank_date, i := bank_id)) AS DOUBLE) AS calculated, count(*) AS n_wrong FROM w GROUP BY account
""")
def balance_violations(spark, sf_dir):
    rows = ledger.running_balance(ledger_rows(spark, sf_dir), "account", ["bank_date", "bank_id"])
    printed = rows.withColumn("balance", F.col("calculated") + F.when(F.col("bank_id") % 7 == 0, 1).otherwise(0).cast("decimal(18,2)"))
    return plain(ledger.balance_violations(printed, "account", ["bank_date", "bank_id"]).drop("bank_date"))


@query(f"WITH b AS ({BANKS}), p AS (SELECT account, bank_id, bank_date, lag(bank_date) OVER (PARTITION BY account ORDER BY bank_id) AS previous FROM b) SELECT account, bank_id, CAST(bank_date AS VARCHAR) AS bank_date, CAST(previous AS VARCHAR) AS previous FROM p WHERE previous > bank_date")
def date_monotonic(spark, sf_dir):
    return plain(ledger.dates_out_of_order(bank_lines(spark, sf_dir), ["account"], ["bank_id"], "bank_date").select("account", "bank_id", "bank_date", "previous"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS printed FROM events)
SELECT user_id, event_id, last_value(printed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM e
""")
def carry_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("printed", F.when(F.col("event_type") == "signup", F.col("ts").cast("date").cast("string")))
    return plain(ledger.carried_forward(events, ["user_id"], ["event_id"], "printed", "carried").select("user_id", "event_id", "carried"))


@query(f"""
WITH b AS ({BANKS}), n AS (SELECT account, bank_id, row_number() OVER (PARTITION BY account ORDER BY bank_date, bank_id) AS sequence FROM b)
SELECT bank_id, sequence, md5(CAST(account AS VARCHAR)) || ':' || lpad(CAST(sequence AS VARCHAR), 4, '0') AS transaction_id, 'B' || sequence AS short_id FROM n
""")
def sequence_ids(spark, sf_dir):
    rows = ledger.numbered(bank_lines(spark, sf_dir), ["account"], ["bank_date", "bank_id"], F.md5(F.col("account").cast("string").cast("binary")))
    return plain(rows.select("bank_id", "sequence", "transaction_id", "short_id"))


@query("""
WITH n AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
SELECT conv_id, CAST(g AS BIGINT) AS "group", min(turn) AS first, count(*) AS lines, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS narration FROM n GROUP BY conv_id, g
""")
def continuation_groups(spark, sf_dir):
    rows = ledger.continuation_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "text")
    return plain(rows.withColumn("narration", F.md5(F.col("narration").cast("binary"))))


@query(f"WITH {LEDGER} SELECT account, CAST(sum(money_in) AS DOUBLE) AS total_in, CAST(sum(money_out) AS DOUBLE) AS total_out, count(*) FILTER (money_in > 0) AS n_in, count(*) FILTER (money_out > 0) AS n_out FROM l GROUP BY account")
def statement_totals(spark, sf_dir):
    return plain(ledger.statement_totals(ledger_rows(spark, sf_dir), "account"))


@query(f"WITH b AS ({BANKS}) SELECT account, count(DISTINCT status || priority) = 1 AS constant, count(DISTINCT status || priority) AS variants FROM b GROUP BY account")
def header_consistency(spark, sf_dir):
    return plain(ledger.header_constant(bank_lines(spark, sf_dir), "account", ["status", "priority"]))


@query(r"""
WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id * 100000 + unnest(range(1, len(lines) + 1)) AS row_id, doc_id, source, unnest(lines) AS line FROM s),
r AS (SELECT row_id, source, line, line LIKE '%CHARGE%' OR regexp_matches(line, '\bFEE\b') AS fee, CASE WHEN doc_id % 2 = 0 THEN regexp_extract(line, '^([^ ]+ [^ ]+)', 1) ELSE '' END AS party FROM l),
k AS (SELECT DISTINCT source, party AS known FROM r WHERE length(party) >= 6),
f AS (SELECT row_id, max(struct_pack(l := length(known), k := known)).k AS filled FROM r JOIN k USING (source) WHERE party = '' AND NOT fee AND (starts_with(line, known || ' ') OR ends_with(line, ' ' || known)) GROUP BY row_id)
SELECT row_id, coalesce(nullif(party, ''), filled) AS filled FROM r LEFT JOIN f USING (row_id)
""")
def payee_backfill(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    party = F.when(F.col("doc_id") % 2 == 0, F.regexp_extract("line", "^([^ ]+ [^ ]+)", 1)).otherwise("")
    rows = lines.select((F.col("doc_id") * 100_000 + F.col("pos") + 1).alias("row_id"), "source", "line", party.alias("party"))
    return plain(ledger.payee_backfill(rows, "source", "row_id", "party", "line", "line").select("row_id", "filled"))


_CODE = "CASE l_returnflag WHEN 'A' THEN ' rm' WHEN 'N' THEN 'usd ' END"


@query(f"""
WITH c AS (SELECT l_returnflag AS flag, {_CODE} AS code FROM lineitem)
SELECT flag, CASE WHEN upper(trim(code)) = 'RM' THEN 'MYR' ELSE upper(trim(code)) END AS currency, count(*) AS n FROM c GROUP BY 1, 2
""")
def currency_normalise(spark, sf_dir):
    code = F.when(F.col("l_returnflag") == "A", " rm").when(F.col("l_returnflag") == "N", "usd ")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), M.normalize_currency(code).alias("currency"))
    return plain(rows.groupBy("flag", "currency").agg(F.count("*").alias("n")))


@query(f"""
WITH t AS (SELECT bank_id, CASE status WHEN 'F' THEN CAST(bank_amount AS VARCHAR) WHEN 'O' THEN format('{{:,.2f}}', CAST(bank_amount AS DOUBLE)) ELSE '-' || CAST(bank_amount AS VARCHAR) END AS text FROM ({BANKS}))
SELECT bank_id, text, CASE WHEN regexp_full_match(text, '[0-9]+(\\.[0-9]{{1,2}})?') THEN CAST(text AS DOUBLE) END AS reviewed,
       CASE WHEN regexp_full_match(text, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)\\.[0-9]{{2}}') THEN CAST(replace(text, ',', '') AS DOUBLE) END AS printed FROM t
""")
def strict_amounts(spark, sf_dir):
    b = bank_lines(spark, sf_dir)
    text = F.when(F.col("status") == "F", F.col("bank_amount").cast("string")).when(F.col("status") == "O", M.written(F.col("bank_amount"))).otherwise(F.concat(F.lit("-"), F.col("bank_amount").cast("string")))
    rows = b.select("bank_id", text.alias("text"))
    return plain(rows.select("bank_id", "text", M.strict_amount(F.col("text")).alias("reviewed"), M.bank_cell(F.col("text")).alias("printed")))


@query(f"""
WITH t AS (SELECT bank_id, CASE status WHEN 'F' THEN '=' WHEN 'O' THEN '-' ELSE '' END || priority AS v FROM ({BANKS}))
SELECT bank_id, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END AS value FROM t
""")
def formula_escape(spark, sf_dir):
    b = bank_lines(spark, sf_dir)
    head = F.when(F.col("status") == "F", "=").when(F.col("status") == "O", "-").otherwise("")
    return plain(b.select("bank_id", M.formula_escape(F.concat(head, "priority")).alias("value")))


@query(f"""
SELECT bank_id, concat_ws(' : ', c_name, CASE WHEN priority <> '4-NOT SPECIFIED' THEN priority END, format('{{:,.2f}}', CAST(bank_amount AS DOUBLE))) AS particular
FROM ({BANKS}) LEFT JOIN customer ON c_custkey = account
""")
def particulars(spark, sf_dir):
    rows = bank_lines(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("account") == F.col("c_custkey"), "left")
    known = F.when(F.col("priority") != "4-NOT SPECIFIED", F.col("priority"))
    return plain(rows.select("bank_id", M.particulars(F.col("c_name"), known, M.written(F.col("bank_amount"))).alias("particular")))
