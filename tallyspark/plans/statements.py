"""Queries of bank layouts and sheets: statements are printed from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import banks, office
from .standins import plain, query, table

_PRINTED = """
o AS (SELECT o_custkey AS source, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS debit, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS credit,
  count(*) FILTER (o_orderkey % 3 = 0) AS debits, count(*) FILTER (o_orderkey % 3 <> 0) AS credits, max(CAST(o_orderdate AS DATE)) AS period FROM orders GROUP BY o_custkey),
s AS (SELECT *, ['maybank', 'public_bank', 'hong_leong', 'cimb', 'other'][source % 5 + 1] AS bank, source % 7 = 0 AS twice, source % 11 = 0 AS lacking FROM o)
"""


@query(f"""
WITH {_PRINTED}
SELECT source, bank, CASE WHEN bank = 'cimb' THEN '12-' || lpad(CAST(source AS VARCHAR), 7, '0') || '-1' WHEN bank <> 'other' THEN lpad(CAST(source AS VARCHAR), 10, '0') END AS account,
  CASE WHEN bank <> 'other' AND NOT lacking THEN CAST(period AS VARCHAR) END AS period, CASE WHEN bank <> 'other' AND NOT twice THEN 1000.5 END AS opening, CASE WHEN bank <> 'other' THEN CAST(1000.5 + credit - debit + 1000000000 AS DOUBLE) END AS closing,
  CASE WHEN bank <> 'other' THEN CAST(debit AS DOUBLE) END AS debit, CASE WHEN bank <> 'other' THEN CAST(credit AS DOUBLE) END AS credit,
  CASE WHEN bank NOT IN ('other', 'maybank') THEN debits END AS debits, CASE WHEN bank NOT IN ('other', 'maybank') THEN credits END AS credits,
  CASE WHEN bank = 'other' THEN 'bank' ELSE concat_ws(' ', CASE WHEN lacking THEN 'period' END, CASE WHEN twice THEN 'opening' END) END AS problems FROM s
""")
def header_facts(spark, sf_dir):
    """Two or three pages a customer in the style of its bank; some say a fact twice, some leave one out."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    out, zero = k % 3 == 0, F.lit(0).cast("decimal(18,2)")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(
        F.sum(F.when(out, price).otherwise(zero)).alias("debit"), F.sum(F.when(out, zero).otherwise(price)).alias("credit"), F.count_if(out).alias("debits"), F.count_if(~out).alias("credits"), F.max(F.col("o_orderdate").cast("date")).alias("period"))
    source = F.col("source")
    s = s.withColumn("bank", F.get(F.array(*map(F.lit, ["maybank", "public_bank", "hong_leong", "cimb", "other"])), (source % 5).cast("int")))
    money = lambda c: F.format_number(c, 2)
    closing, account, lacking = money(F.lit(1000000000 + 1000.5).cast("decimal(18,2)") + F.col("credit") - F.col("debit")), F.lpad(source.cast("string"), 10, "0"), source % 11 == 0
    again = F.when(source % 7 == 0, 2).otherwise(1)
    dated = lambda label, shape: F.when(lacking, F.lit("")).otherwise(F.concat(F.lit(label), F.date_format("period", shape)))
    opening = lambda label: F.repeat(F.concat(F.lit(f"{label} 1,000.50\n")), again)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cover = (
        F.when(F.col("bank") == "maybank", join("CCA SME FIRST ACCOUNT\n戶號 : ", account, "\n", dated("結單日期 : ", "dd/MM/yy"), "\n", opening("BEGINNING BALANCE")))
        .when(F.col("bank") == "public_bank", join("Account Type RM Plus Current Account\nAccount Number ", account, "\n", dated("Statement Date ", "dd MMM yyyy"), "\nTotal Debits ", money(F.col("debit")), "\nTotal Credits ", money(F.col("credit")), "\nNo. of Debits ", F.col("debits").cast("string"), "\nNo. of Credits ", F.col("credits").cast("string")))
        .when(F.col("bank") == "hong_leong", join("A/C No /No Akaun : ", account, " MYR\n", dated("Date / Tarikh : ", "dd-MM-yyyy"), "\nStatement Period / : 01/01/95 - 31/01/95\n"))
        .otherwise(join("(RM) (RM) (RM)\nAccount No / No Akaun 12-", F.lpad(source.cast("string"), 7, "0"), "-1\n", dated("Statement Date / Tarikh Penyata ", "dd/MM/yyyy")))
    )
    middle = F.when(F.col("bank") == "public_bank", opening("Balance From Last Statement")).when(F.col("bank") == "hong_leong", opening("Balance from previous statement")).when(F.col("bank") == "cimb", opening("Opening Balance")).otherwise("nothing here 12.00")
    last = (
        F.when(F.col("bank") == "maybank", join("ENDING BALANCE : ", closing, "\nTOTAL DEBIT : ", money(F.col("debit")), "\nTOTAL CREDIT : ", money(F.col("credit"))))
        .when(F.col("bank") == "public_bank", join("Closing Balance In This Statement ", closing))
        .when(F.col("bank") == "hong_leong", join("Total Withdrawals / Jumlah Pengeluaran : ", F.col("debits").cast("string"), " ", money(F.col("debit")), "\nTotal Deposits / Jumlah Simpanan : ", F.col("credits").cast("string"), " ", money(F.col("credit")), "\nClosing Balance / Baki Akhir: ", closing))
        .otherwise(join("CLOSING BALANCE / BAKI PENUTUP ", closing, "\n", F.col("debits").cast("string"), " ", F.col("credits").cast("string"), " ", money(F.col("debit")), " ", money(F.col("credit")), "\nthanks"))
    )
    pages = s.select("source", "bank", F.posexplode(F.array(cover, middle, last)).alias("page", "text")).withColumn("page", F.col("page") + 1)
    facts = banks.header_facts(pages)
    return plain(facts.select("source", "bank", "account", "period", "opening", "closing", "debit", "credit", "debits", "credits", F.array_join("problems", " ").alias("problems")))


_NARRATED = """
n AS (SELECT o_orderkey AS bank_id, o_orderkey % 22 AS form, o_orderkey % 2 = 1 AS money_in, translate(upper(n_name), '0123456789_', 'ABCDEFGHIJ ') AS party, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS ref FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
"""
#: bank, narration ({p} the party, {r} a reference of 8 digits), what is read of it ({p}, with (in) only where money came in), and of ambank more fields.
_FORMS = [
    ("maybank", "TRANSFER TO A/C\n{p} **\nref {r}", "{p}"), ("maybank", "PAYMENT FR A/C\n{r}\n{p}", "{p}"), ("maybank", "TRANSFER TO A/C", ""), ("maybank", "FEE\n{p}\n{p}", ""),
    ("public_bank", "TSFR FUND DR\n12XX {p}", "{p}"), ("public_bank", "DUITNOW TRSF CR 12 {p}", "{p}"), ("public_bank", "DUITNOW TRSF DR 12 3\n{p} SDN BHD rent\nx", "{p} SDN BHD"), ("public_bank", "DEP-ECP 1\nby MBB\n{p} MBB {r}", "{p}"),
    ("public_bank", "GIRO PYMT\nJOMPAY - A1 - {p}", "{p}"), ("public_bank", "DUITNOW TRSF DR 12 3\n{p} rent", ""),
    ("hong_leong", "Instant Transfer\n{p}\n{r}ABCDEFGHx", "{p}"), ("hong_leong", "Fund Transfer\nx\n{p}", "{p}"), ("hong_leong", "ATM Interbank Funds Trf\nINSTANT TRANSFER\n{p}", "{p}"), ("hong_leong", "Fund Transfer\nx\n{r}", ""),
    ("cimb", "TR IBG 1\n{p}", "{p}"), ("cimb", "TR TO SAVINGS 1\n{p} with a long purpose", ""), ("cimb", "IBG CREDIT 1\na\nb\n{p}", "{p}(in)"),
    ("uob", "FPX Debit\n{r}\n{p}\nLTD\nGEB", "{p} LTD"), ("uob", "x GEB {p}|1 PBB {p} CO|2", "{p} CO"), ("uob", "x GEB A{p}|1 PBB {p} CO|2", ""),
    ("ambank", "DuitNow Transfer,{p},ref {r}", "{p}"), ("ambank", "INWARD IBG,12 {p} level 3,", "{p}"),
]


def _read(form):
    party = f"CASE form {' '.join(f"WHEN {k} THEN replace('{want.removesuffix('(in)')}', '{{p}}', party)" for k, (_, _, want) in enumerate(_FORMS))} END"
    only = [k for k, (_, _, want) in enumerate(_FORMS) if want.endswith("(in)")]
    return f"CASE WHEN form IN ({', '.join(map(str, only))}) AND NOT money_in THEN '' ELSE {party} END"


@query(f"""
WITH {_NARRATED}
SELECT bank_id, {_read("form")} AS counterparty, CASE form WHEN 20 THEN 'DuitNow Transfer' WHEN 21 THEN 'INWARD IBG' END AS transaction_type,
  CASE WHEN form >= 20 THEN CASE WHEN money_in THEN 'payer' ELSE 'recipient' END END AS counterparty_role, CASE form WHEN 20 THEN 'ref ' || ref WHEN 21 THEN 'INWARD IBG' END AS particular FROM n
""")
def narrated_parties(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    k, party, ref = F.col("o_orderkey"), F.translate(F.upper("n_name"), "0123456789_", "ABCDEFGHIJ "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    pick = lambda j: F.get(F.array(*[F.lit(f[j]) for f in _FORMS]), (k % len(_FORMS)).cast("int"))
    narration = F.replace(F.replace(pick(1), F.lit("{p}"), party), F.lit("{r}"), ref)
    read = banks.with_parties(rows.select(k.alias("bank_id"), pick(0).alias("bank"), narration.alias("narration"), (k % 2).alias("money_in")))
    return plain(read.select("bank_id", "counterparty", "transaction_type", "counterparty_role", "particular"))


@query("""
WITH o AS (SELECT o_custkey AS source, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT source, n AS sequence, strftime(d, '%d-%b') AS date_text, 'pay ' || o_orderkey || chr(10) || 'note ' || n AS narration, CAST(CASE WHEN n % 2 = 0 THEN amount ELSE 0 END AS DOUBLE) AS money_out, CAST(CASE WHEN n % 2 = 1 THEN amount ELSE 0 END AS DOUBLE) AS money_in,
  CAST(1000000 + source AS DOUBLE) AS opening, CAST(sum(CASE WHEN n % 2 = 0 THEN amount ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE) AS debit FROM o
""")
def ambank_rows(spark, sf_dir):
    """A page of words a customer: notices, header, opening balance, two lines an order, totals, notices."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").cast("date").alias("d"), F.row_number().over(w).alias("n"))
    money = lambda c: F.format_number(c, 2)
    word = lambda x, text: F.struct(F.lit(float(x)).alias("x"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    line = lambda no, *words: F.struct(no.cast("int").alias("line"), F.array(*words).alias("words"))
    paid = F.when(F.col("n") % 2 == 0, word(320, money(F.col("amount")))).otherwise(word(400, money(F.col("amount"))))
    body = o.select("source", F.explode(F.array(line(10 + 2 * F.col("n"), word(10, F.date_format("d", "dd-MMM")), word(110, F.concat(F.lit("pay "), F.col("o_orderkey").cast("string"))), paid, word(500, "1.00")), line(11 + 2 * F.col("n"), word(110, F.concat(F.lit("note "), F.col("n").cast("string")))))).alias("l"))
    zero = F.lit(0).cast("decimal(18,2)")
    sums = o.groupBy("source").agg(F.max("n").alias("n"), F.sum(F.when(F.col("n") % 2 == 0, F.col("amount")).otherwise(zero)).alias("debit"), F.sum(F.when(F.col("n") % 2 == 1, F.col("amount")).otherwise(zero)).alias("credit"))
    end = 12 + 2 * F.col("n")
    frame = sums.select("source", F.explode(F.array(
        line(F.lit(1), word(10, "01-Jan"), word(400, "5.00")), line(F.lit(2), word(0, banks.AMBANK_HEADER)), line(F.lit(3), word(0, "TARIKH TRANSAKSI")),
        line(F.lit(4), word(0, banks.AMBANK_OPENING), word(490, money((1000000 + F.col("source")).cast("decimal(18,2)")))),
        line(end, word(0, banks.AMBANK_TOTAL), word(330, money(F.col("debit"))), word(410, money(F.col("credit")))), line(end + 1, word(10, "02-Feb"), word(400, "7.00")),
    )).alias("l"))
    words = body.unionByName(frame).select("source", F.lit(1).alias("page"), "l.line", F.explode("l.words").alias("w")).select("source", "page", "line", "w.*")
    rows, controls = banks.ambank_statement(words)
    return plain(rows.join(controls, "source").select("source", "sequence", "date_text", "narration", "money_out", "money_in", "opening", "debit"))


@query("""
WITH o AS (SELECT o_custkey AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT CAST(sheet AS VARCHAR) AS path, n + CASE WHEN n > 4 THEN 3 ELSE 2 END AS row_no, 'P ' || o_orderkey AS party, CAST(amount AS DOUBLE) AS amount, CASE WHEN n > 4 THEN 'A' || (n + 3) || ',AB' || (n + 3) ELSE 'B' || (n + 2) || ',D' || (n + 2) END AS cells
FROM o WHERE o_orderkey % 5 NOT IN (1, 2)
""")
def payable_rows(spark, sf_dir):
    """A sheet a customer: a line before the header, four rows, then the header anew over other columns. Some rows lack the name or owe nothing."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), k, F.row_number().over(w).alias("n"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("amount"))
    first = F.col("n") <= 4
    row = F.col("n") + F.when(first, 2).otherwise(3)
    name = F.when(k % 5 == 1, F.lit(" ")).otherwise(F.concat(F.lit(" P "), k.cast("string")))
    owed = F.when(k % 5 == 2, F.lit("-5")).when(k % 5 == 3, F.concat(F.lit("RM "), "amount")).otherwise(F.col("amount"))
    cell = lambda row, column, value: F.struct(row.cast("int").alias("row"), (F.lit(column) if isinstance(column, str) else column).alias("column"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    body = o.select("path", F.explode(F.array(cell(row, F.when(first, "B").otherwise("A"), name), cell(row, "C", "note = 7.00"), cell(row, F.when(first, "D").otherwise("AB"), owed))).alias("c"))
    head = o.filter("n = 1").select("path", F.explode(F.array(cell(F.lit(1), "B", "someone"), cell(F.lit(1), "D", "12.00"), cell(F.lit(2), "A", "Full Name"), cell(F.lit(2), "B", "姓名 "), cell(F.lit(2), "D", "Amount (RM)"), cell(F.lit(7), "A", "FULL NAME"), cell(F.lit(7), "AB", "金额\t(RM)"))).alias("c"))
    texts = F.transform(F.sort_array(F.collect_list("c")), lambda c: F.concat(c["column"], c["row"].cast("string"), F.lit("="), c["value"]))
    units = body.unionByName(head).groupBy("path").agg(F.array_join(texts, " | ").alias("text")).select(F.col("path").cast("string").alias("path"), F.lit("Sheet1").alias("label"), "text")
    found = office.payable_rows(office.cells(units))
    return plain(found.select("path", "row_no", "party", "amount", F.array_join("cells", ",").alias("cells")))
