"""What is shuffled: hash exchanges in the plans, with joins that nothing small enough to broadcast cuts short."""

from decimal import Decimal as D

import pytest

from tallyspark.operators import groups, ledger, proposals, reviews
from tallyspark.sources import banks, statements

MONEY = "decimal(18,2)"


@pytest.fixture()
def shuffles(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_allocation_rules_shuffle_pieces_once(spark, shuffles):
    rows = [(1, "strong", "a", D(5)), (2, "strong", "a", D(3)), (2, "strong", "a", D(2)), (3, "none", None, None), (4, "strong", None, None), (5, "strong", "b", D(9)), (6, "strong", "c", None), (7, "strong", "d", D(5)), (8, "none", "a", D(5)), (9, "strong", "x", D(5)), (10, "strong", "c", D(1))]
    asked = spark.createDataFrame(rows, f"bank_id long, assessment string, item_id string, amount {MONEY}")
    banks = spark.createDataFrame([(k, D(5), "MYR") for k in range(1, 12)], f"bank_id long, bank_amount {MONEY}, currency string")
    items = spark.createDataFrame([("a", D(5), "MYR"), ("b", D(5), "MYR"), ("c", None, "MYR"), ("d", D(5), "USD")], f"item_id string, amount {MONEY}, currency string")
    allowed = spark.createDataFrame([(k, i) for k in range(1, 11) for i in "abcd"] + [(1, "a")], "bank_id long, item_id string")
    found = proposals.allocation_failures(asked, banks, items, allowed)
    piece, bank = "exceeds the piece", "unknown or repeated piece"
    want = {1: None, 2: bank, 3: None, 4: "strong but incomplete", 5: piece, 6: "strong but incomplete", 7: "currency", 8: "none with allocations", 9: bank, 10: piece, 11: "not returned"}
    assert {r["bank_id"]: r["failure"] for r in found.collect()} == want
    assert shuffles(found) <= 4


def test_guard_shuffles_proposals_twice(spark, shuffles):
    asked = spark.createDataFrame([(1, "a", D(5)), (2, "a", D(1)), (2, "b", D(1)), (3, "b", D(1)), (4, None, D(1)), (5, "x", D(9)), (6, "b", None)], f"bank_id long, item_id string, amount {MONEY}")
    capacity = spark.createDataFrame([("a", D(5)), ("b", D(5)), ("c", None)], f"item_id string, amount {MONEY}")
    found = proposals.over_allocated(asked, capacity)
    assert sorted((r["bank_id"], r["assessment"]) for r in found.collect()) == [(1, "tentative"), (2, "tentative"), (2, "tentative"), (3, "strong"), (4, "strong"), (5, "strong"), (6, "strong")]
    assert shuffles(found) <= 4


def test_page_errors_shuffle_words_once(spark, shuffles):
    receipt = "struct<document_type:string,total:string,currency:string,invoice_numbers:array<string>,limitations:array<string>>"
    row = lambda page: (page, True, None, None, [("receipt", "5.00", "MYR", ["A1", None, "A2"], [])], None, None)
    results = spark.createDataFrame([row(1), row(2)], f"page int, readable boolean, limitations array<string>, review_warnings array<string>, receipts array<{receipt}>, money array<struct<role:string,amount:string,currency:string>>, totals array<struct<label:string,amount:string,currency:string>>")
    words = spark.createDataFrame([(1, "(5.00);"), (1, "MYR"), (1, "A2:"), (1, None), (3, "A1")], "page int, text string")
    found = reviews.page_errors(results, words)
    assert {r["page"]: r["errors"] for r in found.collect()} == {1: ["unsupported_invoice_0"], 2: ["unsupported_currency", "unsupported_invoice_0", "unsupported_invoice_2", "unsupported_total"]}
    assert shuffles(found) <= 2


def test_statements_are_validated_in_one_pass(spark, shuffles):
    rows = spark.createDataFrame([(1, 1, D(0), D(5), D(0), D(5)), (1, 2, D(0), D(0), D(2), D(9)), (2, 1, D(0), D(1), D(1), None), (3, 1, D(0), D(5), D(0), D(5))], f"s int, n int, opening {MONEY}, money_in {MONEY}, money_out {MONEY}, balance {MONEY}")
    printed = spark.createDataFrame([(1, D(4), D(6), D(2)), (2, D(0), D(1), D(2))], f"s int, closing {MONEY}, printed_in {MONEY}, printed_out {MONEY}")
    found = ledger.validate_statement(rows, printed, "s", ["n"])
    assert sorted(map(tuple, found.collect())) == [(1, "balance"), (1, "closing balance"), (1, "money in"), (2, "money out"), (2, "one positive side")]
    assert shuffles(found) <= 2


def test_subsets_of_other_sums_are_not_multiplied_out(spark):
    import itertools
    import random

    rng = random.Random(3)
    cases = {k: [D(rng.randint(-3, 6)) / 4 * 10 ** rng.choice([0, 0, 13]) for _ in range(rng.randint(2, 7))] for k in range(30)}
    rows = [(k, D(3) if k % 9 else None, k, f"i{j}", a) for k, amounts in cases.items() for j, a in enumerate(amounts)]
    found = groups.exact_subsets(spark.createDataFrame(rows, f"bank_id long, bank_amount {MONEY}, claim_group long, item_id string, amount {MONEY}"))
    want = [(k, [f"i{j}" for j in c]) for k, amounts in cases.items() if k % 9 for n in range(2, 8) for c in itertools.combinations(range(len(amounts)), n) if sum(amounts[j] for j in c) == 3]
    assert want and sorted((r["bank_id"], r["items"]) for r in found.collect()) == sorted(want)
    assert "explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_statement_is_read_where_its_words_are(spark, shuffles):
    layout = statements.Layout("l", {"date": (0, 100), "narration": (50, 200), "money_in": (200, 300)})
    words = spark.createDataFrame([("s", 1, 1, 250.0, "5.00"), ("s", 1, 1, 60.0, "Jan"), ("s", 1, 1, 10.0, "01"), ("s", 1, 2, 120.0, "b"), ("s", 1, 2, 110.0, "a"), ("s", 1, 2, 105.0, None), ("s", 1, 3, 300.0, "x"), ("s", 1, 4, None, "y")], "source string, page int, line int, x double, text string")
    assert sorted(map(tuple, statements.lines_of(words, layout).collect())) == [("s", 1, 1, "01 Jan", "", "5.00"), ("s", 1, 2, "", "a b", "")]
    assert [tuple(r)[1:6] for r in statements.statement_rows(words, layout).select("source", "sequence", "page", "date_text", "narration", "money_in").collect()] == [(1, 1, "01 Jan", "a b", D("5.00"))]
    rows, controls = banks.ambank_statement(words)
    assert shuffles(rows) <= 1 and shuffles(controls) <= 1


def test_retrieval_slots_shuffle_pieces_once_into_parts_of_bounded_size(spark, shuffles, tmp_path):
    import random

    from tallyspark.operators import cut
    from tallyspark.plans import fields, standins

    from .oracle import assert_same

    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    rows = [(pick(1, 1, 1, 2, 3, 4, None), rng.randrange(120) if rng.random() < 0.97 else None, pick(1, 2, 3, 4, 5, 6, None), pick(3.0, 8.0, 14.0, 45.0, 46.0, 50.0, None) if rng.random() < 0.3 else 10.0, rng.randrange(90)) for _ in range(900)]
    rows += [(9, k, 1, 10.0 + k, k) for k in range(12)] + [(10, k, None, 10.0, k) for k in range(3)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/many")
    (next((tmp_path / "many").glob("*.parquet"))).rename(tmp_path / "lineitem.parquet")
    found = fields.retrieval_slots(spark, str(tmp_path))
    assert shuffles(found) <= 1
    assert_same(spark, fields.retrieval_slots, standins.SQL["retrieval_slots"], str(tmp_path))
    few = cut.spread(spark.range(1000).selectExpr("id % 40 as k"), "k", most=100)
    assert few.rdd.getNumPartitions() == 10 and few.distinct().count() == 40


def test_amounts_near_to_none_are_not_shuffled(spark):
    import datetime as dt

    from tallyspark.operators import routes

    day = dt.date(2024, 1, 1)
    banks = spark.createDataFrame([(k, D(5 + k), day) for k in range(40)] + [(99, None, day)], f"bank_id long, bank_amount {MONEY}, bank_date date")
    items = spark.createDataFrame([(f"i{k}", D(5) if k < 3 else D("7.03") if k == 3 else D(500 + k), day) for k in range(60)] + [("n", None, day)], f"item_id string, amount {MONEY}, item_date date")
    best, alone = routes.amount_top(banks, items, 2), routes.amount_alone(banks, items)
    assert sorted((r["bank_id"], r["item_id"], r["rank"]) for r in best.collect()) == [(0, "i0", 1), (0, "i1", 2), (2, "i3", 1)]
    assert [(r["bank_id"], r["item_id"]) for r in alone.collect()] == [(2, "i3")]
    for found in (best, alone):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") >= 3  # where rows are read


def test_lines_and_items_of_one_shown_amount_make_few_pairs(spark):
    import datetime as dt
    import random

    from tallyspark.operators import routes

    rng = random.Random(4)
    day = lambda k: [dt.date(2024, 1, 1 + k % 28)]
    banks = [(k, rng.choice([D("12.25"), D("70.00"), None]), rng.choice(["MYR", "SGD", None]), day(k)) for k in range(30)]
    items = [(f"i{k:02d}", rng.choice([D("12.20"), D(500), D(500), None]), rng.choice(["MYR", "rm ", None, "USD"]), day(k), rng.choice(["in/12.25/70.00.pdf", "in/12.25/12.25/a.pdf", "in/a.pdf", None])) for k in range(60)]
    chosen = [(b[0], i[0]) for b in banks for i in items if rng.random() < 0.15]
    b = spark.createDataFrame(banks, f"bank_id long, bank_amount {MONEY}, currency string, dates array<date>")
    i = spark.createDataFrame(items, f"item_id string, amount {MONEY}, currency string, dates array<date>, path string")
    got = sorted(map(tuple, routes.filename_top(b, i, spark.createDataFrame(chosen, "bank_id long, item_id string"), 3).collect()))
    code = {"MYR": "MYR", "rm ": "MYR"}
    want = []
    for bank, amount, currency, dates in banks:
        able = [x for x in items if amount is not None and x[4] and str(amount) in x[4] and (x[1] is None or abs(amount - x[1]) > D("0.05")) and (bank, x[0]) not in chosen and (currency is None or x[2] is None or code.get(currency, currency) == code.get(x[2], x[2]))]
        want += [(bank, x[0], n, abs((dates[0] - x[3][0]).days)) for n, x in enumerate(sorted(able)[:3], 1)]
    assert want and got == sorted(want)


def test_pairs_of_an_index_compare_no_whole_keys(spark):
    import random

    from tallyspark.operators import routes

    rng = random.Random(9)
    some = lambda letters: rng.choice([None, rng.sample(letters, rng.randint(0, 3))])
    row = lambda k: (k, rng.choice([None, D(1), D(2), D("2.5")]), some("abcd"), some("uvwxyz"))
    banks, items = [row(k) for k in range(60)], [row(k) for k in range(50)]
    kinds = f"id long, amount {MONEY}, refs array<string>, tokens array<string>"
    of = lambda rows, name: spark.createDataFrame(rows, kinds.replace("id", name, 1))
    found = routes.token_index(of(banks, "bank_id"), of(items, "item_id"))
    share = lambda a, b: bool(set(a or ()) & set(b or ()))
    score = lambda b, i: 40 * (b[1] is not None and b[1] == i[1]) + 100 * share(b[2], i[2]) + 30 * share(b[3], i[3])
    assert sorted(map(tuple, found.collect())) == sorted((b[0], i[0], score(b, i)) for b in banks for i in items if score(b, i))
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
