"""Column functions on table-driven cases."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import money as M
from tallyspark.functions import text as T


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [(" rm ", "MYR"), ("usd", "USD"), (None, None)])
def test_currency(spark, raw, want):
    assert one(spark, M.normalize_currency(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("12.5", D("12.50")), ("12", D("12.00")), ("1,200.00", None), ("-1", None), ("1.234", None), ("", None), (None, None)])
def test_strict_amount(spark, raw, want):
    assert one(spark, M.strict_amount(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1,200.00", D("1200.00")), ("1200.00", D("1200.00")), ("12,00.00", None), ("12", None), ("12.5", None)])
def test_bank_cell(spark, raw, want):
    assert one(spark, M.bank_cell(F.col("a")), a=raw) == want


def test_number_keeps_zero_apart_from_unknown(spark):
    assert one(spark, M.number(F.col("a")), a="0") == 0
    assert one(spark, M.number(F.col("a")), a="") is None
    assert one(spark, M.number(F.col("a")), a="NaN") is None


@pytest.mark.parametrize(("a", "b", "want"), [("RM", "myr", True), ("USD", "MYR", False), (None, "MYR", True), ("", "MYR", True)])
def test_currencies_agree(spark, a, b, want):
    assert one(spark, M.currencies_agree(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("raw", "want"), [("=1+1", "'=1+1"), ("@x", "'@x"), ("x=1", "x=1"), ("-5", "'-5")])
def test_formula_escape(spark, raw, want):
    assert one(spark, M.formula_escape(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Siti binti Ahmad", "SITI AHMAD", True), ("Ali Store", "Ali Shop", False), ("Kedai Buku Maju Jaya", "kedai buku maju", True), ("", "x", False)],
)
def test_same_name(spark, a, b, want):
    assert one(spark, T.same_name(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("a", "b", "want"), [("MUHAMMAD FAIZA", "Muhammad Faizal", True), ("MUHAMMAD FA", "Muhammad Faizal", False), ("MUHAMMAD FAIZAL", "Muhammad Faizal", False), ("FAIZA", "Faizal", False)])
def test_truncated_name(spark, a, b, want):
    assert one(spark, T.truncated_name(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("raw", "want"), [("Invoice No: AB-0012", "ab-0012"), ("INV-77A1", "inv-77a1"), ("Tax no: 1234", None), ("Booking #abc", None), ("TXN/ 12", None)])
def test_labelled_reference(spark, raw, want):
    assert one(spark, T.labelled_reference(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2025-12-01", dt.date(2025, 12, 1)), ("1 Dec 2025", dt.date(2025, 12, 1)), ("01 december 2025", dt.date(2025, 12, 1)), ("2025年12月1日", dt.date(2025, 12, 1)), ("12/01/2025", None), ("2025-13-01", None)])
def test_parse_date(spark, raw, want):
    assert one(spark, T.parse_date(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("wing-192.80", [D("192.80")]), ("1,316.18 paid", [D("1316.18")]), ("350.- cash", [D("350.00")]), ("wing1", []), ("20251201 rent 90", [D("90.00")]),
        ("01.12.2025 fee 12.5", [D("12.50")]), ("v1.2.3", []), ("1234.567", []),
    ],
)
def test_written_amounts(spark, raw, want):
    assert one(spark, T.written_amounts(T.blank_dates(F.col("a"))), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("ACME SDN BHD", True), ("A1", False), ("REF 123456", False), ("FILE.TXT", False)])
def test_plausible_party(spark, raw, want):
    assert one(spark, T.plausible_party(F.col("a")), a=raw) is want


def test_text_parts(spark):
    assert one(spark, T.text_parts(F.col("a"), 4), a="abcdefghij") == ["abcd", "efgh", "ij"]
    assert one(spark, T.text_parts(F.col("a"), 4), a="") == [""]
    assert one(spark, T.text_parts(F.col("a"), 4), a=None) == [""]


def test_comparison_form(spark):
    assert one(spark, T.nfkc_casefold(F.col("a")), a="Straße ﬁ") == "strasse fi"
    assert one(spark, T.nfkc_casefold(F.col("a")), a=None) is None


def test_grams_ignore_honorifics(spark):
    assert one(spark, T.grams(F.col("a")), a="Cik Ali") == [" AL", "ALI", "LI "]


@pytest.mark.parametrize(
    ("narration", "want"),
    [("paid ＩＮＶ１２３ now", ["a"]), ("STRASSE 99", ["b"]), ("straße99", ["b"]), ("inv 1 2 3", ["a"]), ("INV123.", ["a"]), ("INV123.4", []), ("x-INV123", []), ("(INV123)", ["a"]), ("INV1234", [])],
)
def test_references_and_narrations_have_one_form(spark, narration, want):
    from tallyspark.operators import routes

    items = spark.createDataFrame([("a", "Inv 123"), ("b", "Straße 99")], "item_id string, ref string").select("item_id", F.array(T.normalize_reference(F.col("ref"))).alias("refs"))
    found = routes.narrated_references(spark.createDataFrame([(1, narration)], "bank_id int, narration string"), items)
    assert [r["item_id"] for r in found.collect()] == want


def test_typed_references_take_any_digits(spark):
    assert one(spark, T.typed_reference(F.lit("Invoice_Number"), F.col("a")), a="ＡＢ ١٢") == "ab١٢"
