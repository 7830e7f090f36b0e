"""Operators on small labelled cases."""

import datetime as dt
import math
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators import duplicates, groups, joins, ledger, proposals, reviews, routes, scoring, usage

MONEY = "decimal(18,2)"
BANK = f"bank_id string, bank_amount {MONEY}, currency string, dates array<date>, parties array<string>, refs array<string>"
ITEM = f"item_id string, document string, amount {MONEY}, currency string, dates array<date>, parties array<string>, refs array<string>, path string, excluded boolean, retired boolean"


def bank(spark, *rows):
    return spark.createDataFrame([(i, D(a), "MYR", [dt.date(2025, 12, 1)], p, r) for i, a, p, r in rows], BANK)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("p1", "sheet", "90.00", ["Muhammad Faizal Rahman"], "x/sheet.xlsx"), ("p2", "sheet", "90.00", ["Nurul Huda"], "x/sheet.xlsx"),
        ("p3", "receipts", "50.00", [], "x/receipts.pdf"), ("p4", "receipts", "376.15", [], "x/receipts.pdf"),
        ("p5", "wing", "22.71", [], "x/wing-192.80/a.pdf"), ("p6", "tnb", "365.33", ["TNB"], "x/tnb.pdf"),
    ]
    return spark.createDataFrame([(i, d, D(a), "MYR", [], p, [], path, False, False) for i, d, a, p, path in rows], ITEM)


@pytest.mark.parametrize(
    ("amount", "parties", "want"),
    [
        ("90.00", ["MUHAMMAD FAIZAL RAH"], [("p1", "amount"), ("p2", "amount")]), ("365.35", [], [("p6", "amount")]), ("426.15", [], [("p3", "document total"), ("p4", "document total")]),
        ("192.80", [], [("p5", "found by filename")]), ("7777.77", [], []), ("1.00", ["TENAGA NASIONAL BERHAD"], [("p6", "name")]),
    ],
)
def test_rank(spark, items, amount, parties, want):
    got = routes.rank_candidates(bank(spark, ("b", amount, parties, [])), items).orderBy("rank").collect()
    assert [(r["item_id"], r["route"]) for r in got] == want


def test_difference_is_kept(spark, items):
    row = routes.rank_candidates(bank(spark, ("b", "365.35", [], [])), items).first()
    assert row["difference"] == D("0.02")


def test_slots_overshoot_only_by_the_last_unit(spark):
    rows = [("b", k, f"i{k}", 1) for k in range(1, 30)] + [("b", 30, f"d{k}", k) for k in range(1, 6)] + [("b", 31, "late", 1), ("b", 2, "i1", 2)]
    got = routes.content_slots(spark.createDataFrame(rows, "bank_id string, place int, item_id string, pos int")).orderBy("rank").collect()
    assert len(got) == 34 and "late" not in [r["item_id"] for r in got]
    assert [r["item_id"] for r in got][:2] == ["i1", "i2"]


def test_units_without_a_place_come_last_as_in_the_sql(spark, tmp_path):
    import duckdb

    from tallyspark.plans import fields, standins

    rows = [(1, k % 5 or None, k // 2, float(k % 3)) for k in range(90)] + [(2, None, k, None) for k in range(40)] + [(3, 1 if k < 20 else None, k, 1.0) for k in range(40)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = con.execute(standins.SQL["content_slots"]).fetchall()
    assert sorted(map(key, fields.content_slots(spark, str(tmp_path)).collect())) == sorted(map(key, want))


def retrieval(spark, rows):
    return routes.retrieval_slots(spark.createDataFrame(rows, "bank_id string, item_id string, has_ref boolean, name boolean, amount boolean, score double, gap int, conflict boolean"))


def test_retrieval_quotas(spark):
    rows = [("b", f"n{k:02}", False, True, False, 0.0, None, False) for k in range(25)] + [("b", f"a{k:02}", False, False, True, 0.0, None, False) for k in range(25)]
    got = [r["item_id"] for r in retrieval(spark, rows).collect()]
    assert sum(i[0] == "n" for i in got) == 20 and sum(i[0] == "a" for i in got) == 20
    rows = [("b", f"n{k}", False, True, False, 0.0, None, False) for k in range(7)] + [("b", f"t{k:02}", False, False, False, 1.0 + k, None, False) for k in range(15)]
    got = [r["item_id"] for r in retrieval(spark, rows).collect()]
    assert len(got) == 10 and {"t14", "t13", "t12"} <= set(got)
    rows = [("b", f"r{k:02}", True, False, False, 0.0, None, True) for k in range(45)]
    assert retrieval(spark, rows).count() == 40


def test_adaptive_shortlist_keeps_ties(spark):
    rows = spark.createDataFrame([("b", f"i{k}", 40) for k in range(7)], "bank_id string, item_id string, score int")
    assert routes.shortlist(rows).count() == 7 and routes.shortlist(rows, adaptive=False).count() == 5


def test_aliases(spark):
    got = spark.createDataFrame([(["Bayaran KWSP", None],)], "n array<string>").select(routes.with_aliases(F.col("n")).alias("v")).first()["v"]
    assert got == ["Bayaran KWSP", "KUMPULAN WANG SIMPANAN PEKERJA"]


def test_narrated_reference_may_be_spaced(spark):
    banks = spark.createDataFrame([("b", "payment for INV- 77 A1."), ("c", "XINV-77A1")], "bank_id string, narration string")
    items = spark.createDataFrame([("i", ["inv-77a1"])], "item_id string, refs array<string>")
    assert [(r["bank_id"], r["item_id"]) for r in routes.narrated_references(banks, items).collect()] == [("b", "i")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-30, 200), max_size=25), st.lists(st.integers(-30, 200), max_size=25))
def test_tolerance_join_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([(k, D(v) / 100) for k, v in enumerate(left)], f"i int, a {MONEY}")
    b = spark.createDataFrame([(k, D(v) / 100) for k, v in enumerate(right)], f"j int, b {MONEY}")
    got = sorted((r["i"], r["j"]) for r in joins.tolerance_join(a, b, "a", "b").collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if abs(x - y) <= 5)


LEDGER = f"s string, n int, money_in {MONEY}, money_out {MONEY}, balance {MONEY}, opening {MONEY}"


def statement(spark, second="105.00"):
    return spark.createDataFrame([("s", 1, D("10"), D("0"), D("110"), D("100")), ("s", 2, D("0"), D("5"), D(second), D("100"))], LEDGER)


def test_validation(spark):
    printed = spark.createDataFrame([("s", D("105.00"), D("10"), D("5"))], f"s string, closing {MONEY}, printed_in {MONEY}, printed_out {MONEY}")
    assert ledger.validate_statement(statement(spark), printed, "s", ["n"]).count() == 0
    assert [r["check"] for r in ledger.validate_statement(statement(spark, "106.00"), printed, "s", ["n"]).collect()] == ["balance"]
    off = printed.withColumn("printed_in", F.lit("11").cast(MONEY))
    assert [r["check"] for r in ledger.validate_statement(statement(spark), off, "s", ["n"]).collect()] == ["money in"]


def test_inventory_rows_number_paths_one_by_one(spark):
    listed = spark.createDataFrame([("h", f"p{k:02}") for k in (3, 1, 2)] + [("g", "q")], "id string, path string")
    rows = duplicates.inventory_rows(listed, spark.createDataFrame([("h", 0, "a"), ("h", 1, "b"), ("g", 0, "c")], "id string, unit_no int, text string"))
    assert sorted((r["path"], r["unit_no"], r["copy"], r["duplicate"]) for r in rows.collect()) == [(f"p{k:02}", u, k - 1, k > 1) for k in (1, 2, 3) for u in (0, 1)] + [("q", 0, 0, False)]
    assert "collect_list" not in rows._jdf.queryExecution().executedPlan().toString()


def test_payee_backfill_of_a_long_line(spark):
    """Only starts and ends of as many words as a known name has are built: all of this line's would be gigabytes."""
    line = "Alpha Beta " + " ".join(f"word{k}" for k in range(20_000)) + " Gamma Delta Epsilon"
    rows = [("s", 1, "Alpha Beta", "x"), ("s", 2, "Gamma Delta Epsilon", "x"), ("s", 3, None, line), ("s", 4, "", "one Alpha Beta"), ("t", 5, None, line)]
    got = ledger.payee_backfill(spark.createDataFrame(rows, "s string, i int, p string, l string"), "s", "i", "p", "l")
    assert {r["i"]: r["filled"] for r in got.collect()} == {1: "Alpha Beta", 2: "Gamma Delta Epsilon", 3: "Gamma Delta Epsilon", 4: "Alpha Beta", 5: None}


def test_payee_backfill_takes_the_longest(spark):
    rows = [("s", 1, "KEDAI BUKU", ""), ("s", 2, "KEDAI BUKU MAJU", ""), ("s", 3, "", "KEDAI BUKU MAJU rent"), ("s", 4, None, "rent KEDAI BUKU"), ("s", 5, "", "none here")]
    got = ledger.payee_backfill(spark.createDataFrame(rows, "s string, i int, p string, l string"), "s", "i", "p", "l")
    assert {r["i"]: r["filled"] for r in got.collect()} == {1: "KEDAI BUKU", 2: "KEDAI BUKU MAJU", 3: "KEDAI BUKU MAJU", 4: "KEDAI BUKU", 5: None}


def test_guard(spark):
    cap = spark.createDataFrame([("i", D("100")), ("j", D("50"))], f"item_id string, amount {MONEY}")
    got = lambda rows: {r["bank_id"]: r["assessment"] for r in proposals.over_allocated(spark.createDataFrame(rows, f"bank_id string, item_id string, amount {MONEY}"), cap).collect()}
    assert got([("a", "j", D("50")), ("b", "j", D("50"))]) == {"a": "tentative", "b": "tentative"}
    assert got([("a", "i", D("40")), ("b", "i", D("60"))]) == {"a": "strong", "b": "strong"}


def test_reserved_amounts_count(spark):
    used = proposals.reservations(spark.createDataFrame([("a", "i", D("50"), "approved"), ("b", "i", D("9"), "denied"), ("c", "i", None, "approved")], f"bank_id string, item_id string, amount {MONEY}, status string"))
    cap = spark.createDataFrame([("i", D("100")), ("j", None)], f"item_id string, amount {MONEY}")
    assert {r["item_id"]: r["remaining"] for r in proposals.remaining(cap, used).collect()} == {"i": D("50.00"), "j": None}


def test_decide_is_optimistic(spark):
    log = spark.createDataFrame([], f"bank_id string, item_id string, amount {MONEY}, status string, version int")
    event = spark.createDataFrame([("a", "i", D("60"), "approved")], f"bank_id string, item_id string, amount {MONEY}, status string")
    cap = spark.createDataFrame([("i", D("100"))], f"item_id string, amount {MONEY}")
    none = spark.createDataFrame([], f"item_id string, used {MONEY}")
    assert proposals.decide(log, 3, 3, event, none, cap).first()["version"] == 4
    with pytest.raises(ValueError, match="changed"):
        proposals.decide(log, 3, 2, event, none, cap)
    with pytest.raises(ValueError, match="exceeds"):
        proposals.decide(log, 3, 3, event, none.union(spark.createDataFrame([("i", D("50"))], f"item_id string, used {MONEY}")), cap)


def test_subsets(spark):
    rows = [("b", D("60.00"), "g", i, D(a)) for i, a in [("x", "45"), ("y", "15"), ("z", "60"), ("w", None)] if a] + [("b", D("60.00"), "g", "w", None)]
    got = groups.exact_subsets(spark.createDataFrame(rows, f"bank_id string, bank_amount {MONEY}, claim_group string, item_id string, amount {MONEY}")).collect()
    assert [r["items"] for r in got] == [["x", "y"]]
    big = [("b", D("2.00"), "g", f"i{k}", D("1")) for k in range(13)]
    assert groups.exact_subsets(spark.createDataFrame(big, f"bank_id string, bank_amount {MONEY}, claim_group string, item_id string, amount {MONEY}")).count() == 0


def test_components_chain(spark):
    n = 40
    nodes = spark.range(n).withColumnRenamed("id", "bank_id")
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1) if k != 20], "a long, b long")
    got = {r["bank_id"]: r["component"] for r in groups.components(nodes, edges).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(n)}


def test_merge_needs_all_amounts_and_one_currency(spark):
    rows = [("k", 1, D("1"), "MYR", "a"), ("k", 2, D("2"), "MYR", "a"), ("l", 1, None, "MYR", "b"), ("l", 2, D("2"), "USD", "c")]
    got = {r["key"]: r for r in groups.merged_entries(spark.createDataFrame(rows, f"key string, pos int, amount {MONEY}, currency string, text string"), ["key"]).collect()}
    assert (got["k"]["amount"], got["k"]["currency"], got["k"]["text"]) == (D("3.00"), "MYR", "a")
    assert (got["l"]["amount"], got["l"]["currency"], got["l"]["text"]) == (None, None, "b / c")


def test_usage_prefers_reported_then_finished(spark):
    rows = [("a", 1, "finished", 5), ("a", 2, "started", None), ("b", 1, "started", None), ("b", 2, "finished", None)]
    events = spark.createDataFrame(rows, "id string, seq int, status string, tokens int")
    got = {r["id"]: r["seq"] for r in usage.best_attempts(events, "id", F.col("tokens").isNotNull(), F.col("status") == "finished", ["seq"]).collect()}
    assert got == {"a": 1, "b": 2}


def test_drift_and_unmatched(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r["k"], r["state"]) for r in duplicates.source_drift(a, b, "k").collect()} == {(1, "missing"), (3, "unknown")}
    removed = spark.createDataFrame([(1, 2), (2, 9)], "k int, keeper int")
    assert [r["k"] for r in duplicates.unmatched(a, b.filter("k = 3"), removed, "k").collect()] == [2]


def test_folder_rollup(spark):
    got = {r["folder"]: r["n"] for r in scoring.path_rollup(spark.createDataFrame([("a/b/x",), ("a/y",)], "p string"), "p").collect()}
    assert got == {"a": 2, "a/b": 1}


@pytest.mark.parametrize("operator", [lambda d: duplicates.duplicate_groups(d, "k", "t"), lambda d: duplicates.duplicate_summary(d, "k", "t"), lambda d: duplicates.inventory(d, "k", "t")])
def test_empty_tables(spark, operator):
    operator(spark.createDataFrame([], "k string, t string")).collect()


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k"}])
def test_global_numbers_hold_over_many_partitions(spark, conf):
    """Each row has its number, whatever adaptive execution makes of the partitions."""
    conf = conf | {"spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 2_000_000 if len(conf) == 1 else 300_000
        rows = spark.range(n).select((F.col("id") * 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(F.xxhash64("k"))
        got = reviews.global_number(rows, "k", "number").agg(F.count("*"), F.count_if(F.col("number") != F.col("k") / 3 + 1), F.count_distinct("number")).first()
        assert tuple(got) == (n, 0, n)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_global_numbers_of_nothing(spark):
    assert reviews.global_number(spark.createDataFrame([], "k long, number int"), "k", "n").collect() == []


@pytest.mark.parametrize("common", [0, 3, 20, 10**6])
def test_best_texts_are_those_of_all_scores(spark, common):
    """Whatever counts as a common word: ties, queries without rare words, words that no text has."""
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["a", "a", "b", "c"] + [f"w{k}" for k in range(25)])
    corpus = spark.createDataFrame([(i, [word() for _ in range(rng.randint(0, 12))]) for i in range(120)] + [(200 + i, ["w1", "w2"]) for i in range(6)], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(q, [word() for _ in range(rng.randint(1, 5))]) for q in range(25)] + [(90, ["a"]), (91, ["nowhere"]), (92, ["w1", "w2", "w2"]), (93, ["a", "b", "c"])], "query_id long, words array<string>")
    every = {}
    for r in routes.bm25(asked, corpus).collect():
        every.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["doc_id"]))
    got = {}
    for r in routes.bm25_top(asked, corpus, 5, common=common).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["doc_id"]))
    assert got == {q: sorted(rows)[:5] for q, rows in every.items()} and 91 not in got


def test_few_asked_words_shuffle_no_postings(spark):
    """Asked words are few, so texts' words meet them where they are; texts without words or with nulls among them are counted all the same."""
    corpus = spark.createDataFrame([(1, ["a", "b", None]), (2, ["a", "a"]), (3, []), (4, None)], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(1, ["a", None]), (2, ["b", "b", "c"])], "query_id long, words array<string>")
    for found in (routes.bm25(asked, corpus), routes.bm25_top(asked, corpus, 5), routes.bm25_top(asked, corpus, 5, common=0)):
        assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 1)]
        assert round(found.filter("query_id = 2").first()["score"], 6) == round(math.log1p(3.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3))), 6)
    joins_of = lambda found: found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    assert joins_of(routes.bm25(asked, corpus)) == 0 and joins_of(routes.bm25_top(asked, corpus, 5)) <= 1  # of texts that rare words met


def test_shortlist_of_the_index_equals_the_shortlist_of_all_pairs(spark):
    banks = spark.createDataFrame([(1, 5, ["x"], ["p", "q"]), (2, 5, [], ["q"]), (3, None, None, []), (4, 7, ["y", "z"], ["p"])], "bank_id long, amount int, refs array<string>, tokens array<string>")
    rows = [(i, 5 if i % 9 == 0 else 7 if i % 4 == 0 else None, ["x"] if i % 13 == 0 else ["z", "y"] if i % 11 == 0 else None, [["p"], ["q", "p"], ["q"], []][i % 7 % 4]) for i in range(120)]
    items = spark.createDataFrame(rows, "item_id long, amount int, refs array<string>, tokens array<string>")
    mine = {b: (a, set(r or []), set(t)) for b, a, r, t in banks.collect()}
    want = []
    for b, (amount, refs, tokens) in mine.items():
        scores = {i: 40 * (amount is not None and amount == a) + 100 * bool(refs & set(r or [])) + 30 * bool(tokens & set(t)) for i, a, r, t in rows}
        want += [(b, i, s) for i, s in scores.items() if s]
    assert sorted(map(tuple, routes.token_index(banks, items).collect())) == sorted(want)
    expected = routes.shortlist(spark.createDataFrame(want, "bank_id long, item_id long, score int"))
    assert sorted(map(tuple, routes.index_shortlist(banks, items).collect())) == sorted(map(tuple, expected.collect()))
    plan = routes.token_index(banks, items)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan  # no pair is shuffled once more
    by_items = [r for r in routes.index_shortlist(banks, items)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in r]
    assert len(by_items) == 1


def test_best_amounts_equal_the_best_of_all_pairs(spark):
    from decimal import Decimal as D

    days = ["2024-01-01", "2024-01-03", "2024-02-01", None]
    banks = spark.createDataFrame([(b, D(100 + b % 5 * 3) / 100 if b % 6 else None, days[b % 4]) for b in range(24)], "bank_id long, bank_amount decimal(18,2), d string").selectExpr("bank_id", "bank_amount", "cast(d as date) bank_date")
    items = spark.createDataFrame([(f"i{i}", D(95 + i % 20) / 100 if i % 17 else None, days[i * 7 % 4]) for i in range(200)], "item_id string, amount decimal(18,2), d string").selectExpr("item_id", "amount", "cast(d as date) item_date")
    pairs = routes.amount_route(banks, items)
    rank = F.row_number().over(Window.partitionBy("bank_id").orderBy(F.coalesce("gap", F.lit(routes.NO_GAP)), "item_id"))
    want = pairs.withColumn("rank", rank).filter("rank <= 4")
    assert want.count() == 80 and sorted(map(str, routes.amount_top(banks, items, 4).collect())) == sorted(map(str, want.collect()))
    alone = proposals.fastlane(pairs).select("bank_id", "item_id", "difference", "gap")
    lonely = banks.filter("bank_id in (1, 2)"), items.filter("item_id in ('i3', 'i16')")
    for b, i in ((banks, items), lonely):
        alone = proposals.fastlane(routes.amount_route(b, i)).select("bank_id", "item_id", "difference", "gap")
        assert sorted(map(str, routes.amount_alone(b, i).collect())) == sorted(map(str, alone.collect()))
    assert routes.amount_alone(*lonely).count() > 0


def test_names_that_can_take_no_slot_make_no_pairs(spark):
    """Twelve items of the best name fill the slots, so the next name's hundred are left out; without enough of agreeing currency it stays."""
    rows = [(f"a{i:03}", "acme trading", "MYR" if i < 12 else "SGD", [dt.date(2025, 1, 1 + i % 20)]) for i in range(24)] + [(f"b{i:03}", "acme tradings", None, [dt.date(2025, 1, 1)]) for i in range(100)]
    items = spark.createDataFrame(rows, "item_id string, name string, currency string, dates array<date>")
    banks = spark.createDataFrame([(1, "acme trading", "MYR"), (2, "acme trading", None), (3, "acme tradings", "SGD")], "bank_id long, name string, currency string")
    got = routes.best_names(banks, items, 10).groupBy("bank_id", F.substring("item_id", 1, 1).alias("k")).count()
    assert sorted(map(tuple, got.collect())) == [(1, "a", 12), (2, "a", 24), (3, "b", 10)]
    asked = spark.createDataFrame([(1, "a003")], "bank_id long, item_id string")
    assert [tuple(r)[:2] for r in routes.name_route(banks.select("bank_id", "name"), items.select("item_id", "name"), 0.0, asked).collect()] == [(1, "a003")]


def aggregated(df):
    """Rows that each aggregate of an executed plan gave."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("AggregateExec"):
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [children.apply(k) for k in range(children.size())]
    return out


def test_only_ids_of_several_names_have_their_pairs_compared(spark):
    names = ["acme trading", "acme tradings", "acme trader", "beta", "gamma works", None]
    banks = spark.createDataFrame([(b, names[b % 6]) for b in range(300)], "bank_id long, name string")
    items = spark.createDataFrame([(f"i{k}", names[k % 6]) for k in range(40)], "item_id string, name string")
    more_banks = banks.unionByName(spark.createDataFrame([(0, names[0]), (1, names[0]), (1, None), (2, names[4]), (None, names[0]), (None, names[1])], banks.schema))
    more_items = items.unionByName(spark.createDataFrame([("i0", names[0]), ("i1", names[0]), ("i3", names[4]), (None, names[2]), (None, names[0])], items.schema))
    for b, i in ((banks, items), (more_banks, items), (banks, more_items), (more_banks, more_items)):
        near = routes.alike_names(b, i, 0.35)
        want = near.join(i.withColumnRenamed("name", "item_name"), "item_name").join(b.withColumnRenamed("name", "bank_name"), "bank_name").groupBy("bank_id", "item_id").agg(F.max("name").alias("name"))
        rows = lambda frame: sorted((-1 if r["bank_id"] is None else r["bank_id"], r["item_id"] or "", round(r["name"], 9)) for r in frame.collect())
        found = routes.name_route(b, i)
        assert rows(found) == rows(want)
    found = routes.name_route(banks, items)
    pairs = len(found.collect())
    assert pairs > 2000 and max(aggregated(found)) <= 300
