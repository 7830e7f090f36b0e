"""Bank layouts: header facts of a statement, and what a narration says of the other party.

A bank is a row of a registry: patterns of facts, each to be found exactly once in its part of the statement, and rules for its narrations.
All banks are read in one pass over the pages or rows; the bank's own patterns and rules are chosen by its name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import bank_cell
from .statements import Layout, gathered, placed_lines, printed_text, rows_of_lines

COVER, WHOLE, LAST = "cover", "whole", "last"


@dataclass(frozen=True)
class Fact:
    """A pattern that matches once in the first page, in the whole statement or in the last page; the group that holds the value."""

    where: str
    pattern: str
    group: int = 1


@dataclass(frozen=True)
class Bank:
    name: str
    facts: dict[str, Fact]
    date_format: str
    party: Callable[[Column, Column], Column]  # (narration, whether money came in) -> name or ""
    describe: Callable[[Column, Column], dict[str, Column]] | None = None


def one(found: Column) -> Column:
    """The only one of some matches; none and several are unknown."""
    return F.when(F.size(found) == 1, F.get(found, 0))


def line(lines: Column, k: int) -> Column:
    return F.coalesce(F.get(lines, k) if k >= 0 else F.try_element_at(lines, F.lit(k)), F.lit(""))


def starts(text: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def whole_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group if the whole text matches, else null."""
    return F.when(F.regexp_like(text, F.lit(rf"^(?:{pattern})\z")), F.regexp_extract(text, rf"^(?:{pattern})\z", group))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Fixed values from here to the end of BANKS: what these banks print.
MONEY = r"([\d,]+\.\d{2})"
COMPANY = r"^(.*?\b(?:SDN\.? BHD\.?|BHD\.?|S/B|PLT|BERHAD))(?:\s|$)"
BANK_CODES = r"\b(?:GEB|PBB|MBB|ABMB|CIMB|HLB)\s+"
NAMED_TYPES = ("DuitNow Transfer", "DuitNow CR TRF", "Fund Transfer", "Interbank GIRO", "CMS FPX PAYMENT", "IBG OUTWARD RTN", "JomPAY", "CREDIT TRANSFER", "INWARD RENTAS", "INWARD IBG")
COMPANY_TYPES = ("INWARD IBG", "INWARD RENTAS /MISC CREDIT")


def maybank_party(narration: Column, money_in: Column) -> Column:
    lines = F.split(narration, "\n")
    first = line(lines, 0)
    second = F.trim(F.regexp_replace(line(lines, 1), r"[* ]+$", ""))
    return F.when((F.size(lines) > 1) & starts(first, "TRANSFER TO A/C", "TRANSFER FR A/C", "ELECTRONIC REMITTANCE"), second).when((F.size(lines) > 2) & (first == "PAYMENT FR A/C"), line(lines, 2)).otherwise("")


def public_party(narration: Column, money_in: Column) -> Column:
    lines = F.split(narration, "\n")
    first, second, third, many = line(lines, 0), line(lines, 1), line(lines, 2), F.size(lines)
    company = F.when(many > 2, F.nullif(F.regexp_extract(second, COMPANY, 1), F.lit("")))
    padded, code = F.concat(third, F.lit(" ")), F.concat(F.lit(" "), F.substring_index(second, " ", -1), F.lit(" "))
    payer = F.when(F.contains(padded, code), F.call_function("substring_index", padded, code, F.lit(1)))
    party = (
        F.when(starts(first, "TSFR FUND "), whole_match(second, r"\d+X+\s+(.+)"))
        .when(starts(first, "DUITNOW TRSF "), F.coalesce(whole_match(first, r"DUITNOW TRSF (?:CR|DR) \d+ (\D+)"), company))
        .when((many > 2) & starts(first, "DEP-ECP "), payer)
        .when(starts(first, "GIRO PYMT"), whole_match(second, r"JOMPAY - (?U:\w+) - (.+)"))
    )
    return F.coalesce(party, F.lit(""))


def hong_leong_party(narration: Column, money_in: Column) -> Column:
    lines = F.split(narration, "\n")
    first, last, many = line(lines, 0), line(lines, -1), F.size(lines)
    others = F.filter(F.slice(lines, 2, F.greatest(many - 1, F.lit(0))), lambda x: x != "INSTANT TRANSFER")
    party = (
        F.when(starts(first, "Instant Transfer", "CIB Instant Transfer") & F.regexp_like(last, F.lit(r"^\d{8}[A-Z]{8}(?U:\w+)\z")), line(lines, -2))
        .when(starts(first, "JomPAY Bill Payment") & (many == 5), line(lines, -2))
        .when(starts(first, "Fund Transfer", "Fund Trf fr", "Cr Adv-Interbank GIRO"), last)
        .when(starts(first, "ATM Interbank Funds Trf"), one(others))
    )
    named = F.regexp_like(party, F.lit("[A-Za-z]")) & ~F.regexp_like(party, F.lit(r"(?U)\d"))
    return F.when((many >= 3) & F.coalesce(named, F.lit(False)), party).otherwise("")


def cimb_party(narration: Column, money_in: Column) -> Column:
    lines = F.split(narration, "\n")
    first, many = line(lines, 0), F.size(lines)
    short = F.length(line(lines, 1)) <= 20  # the name field's width; a longer line goes on with the purpose
    return (
        F.when((many > 1) & (starts(first, "TR IBG ", "TR TO C/A ") | (starts(first, "TR TO SAVINGS ") & short)), line(lines, 1))
        .when((many >= 4) & F.coalesce(money_in, F.lit(False)) & starts(first, "DUITNOW TO ACCOUNT ", "IBG CREDIT "), line(lines, -1))
        .otherwise("")
    )


def uob_party(narration: Column, money_in: Column) -> Column:
    lines = F.split(narration, "\n")
    many = F.size(lines)
    blocks = F.split(narration, BANK_CODES)
    names = F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: spaced(F.substring_index(b, "|", 1)))
    a, b = line(names, 0), line(names, 1)
    short, full = F.when(F.length(b) < F.length(a), b).otherwise(a), F.when(F.length(b) < F.length(a), a).otherwise(b)
    return (
        F.when((many >= 4) & (line(lines, 0) == "FPX Debit") & (line(lines, -1) == "GEB"), F.array_join(F.slice(lines, 3, F.greatest(many - 3, F.lit(0))), " "))
        .when((F.size(names) == 2) & F.startswith(full, short), full)
        .when((F.size(names) == 1) & (many > 1) & F.startswith(a, line(lines, 1)), a)
        .otherwise("")
    )


def ambank_fields(narration: Column, money_in: Column) -> dict[str, Column]:
    parts = F.split(narration, ",", 3)
    method, raw, details = spaced(F.get(parts, 0)), F.coalesce(F.trim(F.get(parts, 1)), F.lit("")), F.coalesce(F.regexp_replace(F.get(parts, 2), r"^\s+|\s+$", ""), F.lit(""))
    party = F.when(starts(method, *NAMED_TYPES), spaced(raw)).otherwise("")
    party = F.when(method.isin(*COMPANY_TYPES), F.get(F.split(F.regexp_replace(party, r"^\d+\s+", ""), r"(?i)\s+LEVEL\s+"), 0)).otherwise(party)
    role = F.when(starts(method, "IBG OUTWARD RTN"), "original payment recipient").when(F.coalesce(money_in, F.lit(False)), "payer").otherwise("recipient")
    return {"transaction_type": method, "counterparty": party, "counterparty_role": role, "counterparty_raw": raw, "details_raw": details, "particular": F.when(details == "", method).otherwise(details)}


BANKS = {
    b.name: b
    for b in (
        Bank("maybank", {
            "kind": Fact(COVER, r"\b(CCA SME FIRST ACCOUNT)\b"), "account": Fact(COVER, r"戶號\s*:\s*(\d+)"), "period": Fact(COVER, r"結單日期\s*:\s*(\d{2}/\d{2}/\d{2})"),
            "opening": Fact(WHOLE, r"BEGINNING BALANCE\s+" + MONEY), "closing": Fact(WHOLE, r"ENDING BALANCE\s*:\s*" + MONEY),
            "debit": Fact(WHOLE, r"TOTAL DEBIT\s*:\s*" + MONEY), "credit": Fact(WHOLE, r"TOTAL CREDIT\s*:\s*" + MONEY),
        }, "dd/MM/yy", maybank_party),
        Bank("public_bank", {
            "kind": Fact(COVER, r"Account Type\s+(RM Plus Current Account)"), "account": Fact(COVER, r"Account Number\s+(\d+)"), "period": Fact(COVER, r"Statement Date\s+(\d{2} \w{3} \d{4})"),
            "opening": Fact(WHOLE, r"Balance From Last Statement\s+" + MONEY), "closing": Fact(WHOLE, r"Closing Balance In This Statement\s+" + MONEY),
            "debit": Fact(COVER, r"Total Debits\s+" + MONEY), "credit": Fact(COVER, r"Total Credits\s+" + MONEY),
            "debits": Fact(COVER, r"No\. of Debits\s+(\d+)"), "credits": Fact(COVER, r"No\. of Credits\s+(\d+)"),
        }, "dd MMM yyyy", public_party),
        Bank("hong_leong", {
            "account": Fact(COVER, r"A/C No /No Akaun\s*:\s*(\d+) MYR"), "period": Fact(COVER, r"Date / Tarikh\s*:\s*(\d{2}-\d{2}-\d{4})"),
            "start": Fact(COVER, r"Statement Period /\s*:\s*(\d{2}/\d{2}/\d{2}) - (\d{2}/\d{2}/\d{2})"), "end": Fact(COVER, r"Statement Period /\s*:\s*(\d{2}/\d{2}/\d{2}) - (\d{2}/\d{2}/\d{2})", 2),
            "opening": Fact(WHOLE, r"Balance from previous statement\s+" + MONEY), "closing": Fact(WHOLE, r"Closing Balance / Baki Akhir:\s*" + MONEY),
            "debits": Fact(WHOLE, r"Total Withdrawals / Jumlah Pengeluaran\s*:\s*(\d+)\s+" + MONEY), "debit": Fact(WHOLE, r"Total Withdrawals / Jumlah Pengeluaran\s*:\s*(\d+)\s+" + MONEY, 2),
            "credits": Fact(WHOLE, r"Total Deposits / Jumlah Simpanan\s*:\s*(\d+)\s+" + MONEY), "credit": Fact(WHOLE, r"Total Deposits / Jumlah Simpanan\s*:\s*(\d+)\s+" + MONEY, 2),
        }, "dd-MM-yyyy", hong_leong_party),
        Bank("cimb", {
            "kind": Fact(COVER, r"^(\(RM\) \(RM\) \(RM\))$"), "account": Fact(COVER, r"Account No / No Akaun\s+(\d{2}-\d{7}-\d)"), "period": Fact(COVER, r"Statement Date / Tarikh Penyata\s+(\d{2}/\d{2}/\d{4})"),
            "opening": Fact(WHOLE, r"Opening Balance\s+" + MONEY), "closing": Fact(WHOLE, r"CLOSING BALANCE / BAKI PENUTUP\s+" + MONEY),
            "debits": Fact(LAST, rf"^(\d+)\s+(\d+)\s+{MONEY}\s+{MONEY}$", 1), "credits": Fact(LAST, rf"^(\d+)\s+(\d+)\s+{MONEY}\s+{MONEY}$", 2),
            "debit": Fact(LAST, rf"^(\d+)\s+(\d+)\s+{MONEY}\s+{MONEY}$", 3), "credit": Fact(LAST, rf"^(\d+)\s+(\d+)\s+{MONEY}\s+{MONEY}$", 4),
        }, "dd/MM/yyyy", cimb_party),
        Bank("ambank", {"kind": Fact(COVER, r"\A(?s:.*?)(AMBANK)"), "account": Fact(COVER, r"(\d{10,})\s+MYR\s+" + MONEY), "closing": Fact(COVER, r"(\d{10,})\s+MYR\s+" + MONEY, 2)}, "dd-MMM-yyyy", lambda n, i: ambank_fields(n, i)["counterparty"], ambank_fields),
        Bank("uob", {
            "kind": Fact(COVER, r"\A(?s:.*?)(CURRENT_ACCOUNT)"), "account": Fact(COVER, r"^MYR (\d+)$"), "start": Fact(COVER, r"(\d{2}/\d{2}/\d{4}) - (\d{2}/\d{2}/\d{4})"), "period": Fact(COVER, r"(\d{2}/\d{2}/\d{4}) - (\d{2}/\d{2}/\d{4})", 2),
            "records": Fact(COVER, r"^(\d+) Record\(s\) \(Note: This is a filtered table\.\)$"), "header_balance": Fact(COVER, r"Ledger Balance\n[^\n]*MYR " + MONEY),
            "credit": Fact(LAST, r"Total Deposits\(MYR\) Total Withdrawals\(MYR\)\n" + MONEY + r"\s+" + MONEY), "debit": Fact(LAST, r"Total Deposits\(MYR\) Total Withdrawals\(MYR\)\n" + MONEY + r"\s+" + MONEY, 2),
        }, "dd/MM/yyyy", uob_party),
    )
}
# End of the fixed values.

AMOUNTS = ("opening", "closing", "debit", "credit", "header_balance")
COUNTS = ("debits", "credits", "records")
SHORT_DATE = "dd/MM/yy"  # of a period's start and end
PIVOT = 69  # two digits from here on are of the last century


def header_facts(pages: DataFrame, banks: dict[str, Bank] = BANKS) -> DataFrame:
    """Rows (source, bank, account, period, ..., problems) from (source, bank, page, text), pages counted from 1.

    Amounts are decimals, counts whole numbers, dates dates. A fact that its bank prints and that isn't there exactly once is unknown, and its
    name is in `problems`. Pages are searched one by one and only matches are brought together; a source of an unknown bank has the problem "bank".
    """
    names = list(dict.fromkeys(n for b in banks.values() for n in b.facts))
    last = pages.groupBy("source").agg(F.max("page").alias("_last"))
    rows = pages.join(last, "source")
    within = {COVER: F.col("page") == 1, LAST: F.col("page") == F.col("_last"), WHOLE: F.lit(True)}

    def matches(name: str) -> Column:
        out = F.lit(None).cast("array<string>")
        for b in banks.values():
            if f := b.facts.get(name):
                out = F.when((F.col("bank") == b.name) & within[f.where], F.regexp_extract_all("text", F.lit(f"(?m){f.pattern}"), f.group)).otherwise(out)
        return F.coalesce(out, F.array().cast("array<string>"))

    found = rows.select("source", "bank", *[matches(n).alias(n) for n in names])
    facts = found.groupBy("source", "bank").agg(*[one(F.flatten(F.collect_list(n))).alias(n) for n in names])  # of one statement's pages
    expected = {n: F.col("bank").isin(*[b.name for b in banks.values() if n in b.facts]) for n in names}

    def typed(name: str) -> Column:
        if name in AMOUNTS:
            return bank_cell(F.col(name))
        if name in COUNTS:
            return F.col(name).try_cast("bigint")
        if name in ("period", "start", "end"):
            shape = F.lit(None).cast("string")
            for b in banks.values():
                shape = F.when(F.col("bank") == b.name, F.lit(b.date_format)).otherwise(shape)
            long, short = F.try_to_timestamp(F.col(name), shape), F.try_to_timestamp(F.col(name), F.lit(SHORT_DATE))
            date = F.when(F.length(name) == len(SHORT_DATE), short).otherwise(long).cast("date")
            return F.when((F.length(name) == len(SHORT_DATE)) & (F.year(date) >= 2000 + PIVOT), F.add_months(date, -1200)).otherwise(date)
        return F.col(name)

    typed_facts = facts.select("source", "bank", *[typed(n).alias(n) for n in names])
    missing = F.array_compact(F.array(F.when(~F.coalesce(F.col("bank").isin(*banks), F.lit(False)), "bank"), *[F.when(expected[n] & F.col(n).isNull(), n) for n in names]))
    return typed_facts.withColumn("problems", missing)


def with_parties(rows: DataFrame, banks: dict[str, Bank] = BANKS) -> DataFrame:
    """Adds transaction_type, counterparty, counterparty_role, counterparty_raw, details_raw and particular to (bank, narration, money_in).

    counterparty is "" where the bank's layout doesn't mark a name. Banks without fields of their own have the name only.
    """
    money = F.coalesce(F.col("money_in"), F.lit(0)) > 0
    fields = ("transaction_type", "counterparty", "counterparty_role", "counterparty_raw", "details_raw", "particular")
    narration = F.coalesce("narration", F.lit(""))

    def pick(name: str) -> Column:
        out = F.lit("" if name == "counterparty" else None).cast("string")
        for b in banks.values():
            own = b.describe(narration, money)[name] if b.describe else b.party(narration, money) if name == "counterparty" else None
            if own is not None:
                out = F.when(F.col("bank") == b.name, own).otherwise(out)
        return out

    return rows.select(*rows.columns, *[pick(f).alias(f) for f in fields])


def table_lines(lines: DataFrame, header: str, page_end: list[str], skip: list[str], text: str = "text") -> DataFrame:
    """The lines (source, page, line, text, ...) of a page's table: behind its header, before a line that ends it, without those to be skipped."""
    so_far = Window.partitionBy("source", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.max(F.when(F.col(text) == header, F.col("line"))).over(so_far)
    over = F.coalesce(F.max(F.when(starts(F.col(text), *page_end), F.col("line"))).over(so_far), F.lit(-1))
    return lines.withColumn("_begun", begun).withColumn("_over", over).filter((F.col("line") > F.col("_begun")) & (F.col("_over") < F.col("_begun"))).filter(~starts(F.col(text), *skip)).drop("_begun", "_over")


# The columns (points from the left) and printed lines of AmBank's table.
AMBANK_TABLE = Layout("ambank", {"date": (0, 100), "narration": (100, 310), "money_out": (310, 395), "money_in": (395, 480), "balance": (480, 596)})
AMBANK_HEADER, AMBANK_OPENING, AMBANK_TOTAL, AMBANK_SKIPPED = "DATE TRANSACTION CHEQUE NO. DEBIT CREDIT BALANCE", "Balance Brought Fwd", "TOTAL / JUMLAH", ["TARIKH TRANSAKSI"]


def ambank_statement(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, controls) of words (source, page, line, x, text): the transactions, and (source, opening, debit, credit) as printed.

    Opening balance and totals must stand once each; else they are unknown.
    """
    lines = gathered(words).withColumn("text", printed_text(F.col("words")))
    inside = table_lines(lines, AMBANK_HEADER, [AMBANK_TOTAL], AMBANK_SKIPPED)
    brought = F.col("text").startswith(AMBANK_OPENING)
    rows = rows_of_lines(placed_lines(inside.filter(~brought), AMBANK_TABLE), AMBANK_TABLE)
    marked = placed_lines(lines.filter(brought | F.col("text").startswith(AMBANK_TOTAL)).withColumn("opens", brought), AMBANK_TABLE, "opens")
    cell = lambda c, when: bank_cell(F.trim(one(F.collect_list(F.when(when, F.coalesce(F.col(c), F.lit("")))))))
    controls = marked.groupBy("source").agg(cell("balance", F.col("opens")).alias("opening"), cell("money_out", ~F.col("opens")).alias("debit"), cell("money_in", ~F.col("opens")).alias("credit"))
    return rows, controls
